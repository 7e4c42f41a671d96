"""Binary headers, written by hand."""

import lzma
import struct

import pytest

from specgrain.sources import headers


def header(tags):
    store, index = b"", b""
    for tag, kind, value in tags:
        if kind == 4:
            store += b"\0" * (-len(store) % 4)
            body, n = struct.pack(f">{len(value)}I", *value), len(value)
        else:
            value = [value] if isinstance(value, str) else value
            body, n = b"".join(v.encode() + b"\0" for v in value), len(value)
        index += struct.pack(">IIII", tag, kind, len(store), n)
        store += body
    return headers.MAGIC + b"\0" * 4 + struct.pack(">II", len(tags), len(store)) + index + store


ONE = [
    (1000, 6, "tool"), (1001, 6, "2.0"), (1002, 6, "alt1"), (1003, 4, [1]), (1009, 4, [99]), (1022, 6, "x86_64"), (9999, 6, "ignored"),
    (1049, 8, ["lib", "sh", "old"]), (1048, 4, [12, 0, 2]), (1050, 8, ["1:2.34", "", "3-4"]), (1117, 8, ["tool"]), (1118, 8, ["/usr/bin/"]), (1116, 4, [0]),
]


def test_package_lists(spark, tmp_path):
    data = header(ONE) + b"\0\0" + header([(1000, 6, "bare"), (1001, 6, "1")]) + header([(1001, 6, "nameless")])
    (tmp_path / "pkglist.xz").write_bytes(lzma.compress(data[:200]) + lzma.compress(data[200:]))
    rows = {r["name"]: r for r in headers.read_package_lists(spark, str(tmp_path / "pkglist.xz"), "base").collect()}
    tool = rows["tool"]
    assert set(rows) == {"tool", "bare"} and (tool["epoch"], tool["release"], tool["size_installed"], tool["files"]) == (1, "alt1", 99, ["/usr/bin/tool"])
    assert [tuple(c) for c in tool["caps"]] == [("requires", "lib", "GE", 1, "2.34", ""), ("requires", "sh", "NONE", None, None, None), ("requires", "old", "LT", 0, "3", "4")]
    (tmp_path / "short").write_bytes(header(ONE)[:-5])
    with pytest.raises(Exception, match="truncated"):
        headers.read_package_lists(spark, str(tmp_path / "short"), "base").collect()
    with pytest.raises(headers.Broken):
        headers.unpacked(b"BZh91AY")
