"""Shell bodies of recipes as relations: tokens that know quotes, comments, continuations and here-documents, and the commands that they make. No UDF.

A body becomes one text in which every line starts with its number between two control characters; continued lines are joined and here-documents dropped by
patterns over that text, and one pattern cuts it into tokens, in order. What a body's text can't hold (2 GB) can't be told.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_MARK = "\u0001[0-9]++\u0002"
#: A line's number, an end of line, a comment, what ends a command, a redirection, or a word: macros, quoted parts, escaped characters and all else that isn't blank.
_WORD = r"(?:%\{[^}\n]*+\}|\$\{[^}\n]*+\}|" + r'"(?:\\.|[^"\\]++)*+"' + r"|'[^']*+'|\\.|" + "[^\\s;&|()<>\"'\\\\%$\u0001]++|[%$])"
_TOKEN = rf"(?s){_MARK}|\n|(?<=[\s;&|(\u0002])#[^\n]*+|&&|\|\||;;|[;&|()]|[0-9]?(?:<<<|>>|<<-?|>&|<&|>\||<|>)|{_WORD}++"
#: Words that a command may follow.
_BEFORE = ("if", "then", "elif", "else", "while", "until", "do", "!", "{", "time", "sudo", "env", "exec", "command", "nohup")


def shell_tokens(body: DataFrame) -> DataFrame:
    """(spec_id, sec, kind, pkg, pos, line_no, token, type) of body rows of shell sections: type is word, end (of a command), redirect.

    Comments, here-documents and the ends of continued lines are no tokens; a token that runs over lines has the first one's number. Unclosed quotes stand for themselves.
    """
    key = ["spec_id", "sec", "kind", "pkg"]
    line = F.concat(F.lit("\u0001"), F.col("line_no").cast("string"), F.lit("\u0002"), F.col("line"), F.lit("\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("l")))), lambda x: x["l"]), "")
    whole = body.groupBy(*key).agg(text.alias("text"))
    joined = F.regexp_replace("text", rf"\\\n{_MARK}", " ")
    # The body of a here-document goes up to a line that holds its word alone.
    here = rf"(?s)(<<-?\s*+([\"']?)\\?(\w++)\2[^\n]*+)\n.*?\n{_MARK}[ \t]*+\3[ \t]*+(?=\n)"
    tokens = F.regexp_extract_all(F.regexp_replace(joined, here, "$1"), F.lit(_TOKEN), F.lit(0))
    cut = whole.select(*key, F.posexplode(tokens).alias("pos", "token"))
    w = Window.partitionBy("spec_id", "sec").orderBy("pos")
    number = F.when(F.col("token").rlike(f"^{_MARK}$"), F.regexp_extract("token", "([0-9]+)", 1).cast("int"))
    placed = cut.withColumn("line_no", F.last(number, True).over(w)).where(~F.col("token").rlike(f"^(?:{_MARK}|#.*)$"))
    type_ = F.when(F.col("token").rlike(r"^(?:\n|&&|\|\||;;|[;&|()])$"), "end").when(F.col("token").rlike("^[0-9]?[<>]"), "redirect").otherwise("word")
    return placed.select(*key, "pos", "line_no", F.regexp_replace("token", _MARK, "").alias("token"), type_.alias("type"))


def plain(word):
    """A word without its quotes and escapes."""
    return F.regexp_replace(word, r"""\\(.)|["']""", "$1")


def commands(body: DataFrame) -> DataFrame:
    """(spec_id, sec, kind, pkg, line_no, cmd, nth, lead, name, args): the commands of shell bodies.

    cmd numbers them in a body, nth in their line; lead says that nothing stands before the name. name is the first word that is no keyword, wrapper or assignment; args are the plain words
    after it, without redirections and their targets. Words that only assign are no command.
    """
    t = shell_tokens(body)
    w = Window.partitionBy("spec_id", "sec").orderBy("pos")
    ends = F.col("type") == "end"
    t = t.withColumn("cmd", F.sum(ends.cast("int")).over(w)).withColumn("last", F.lag("type").over(w))
    words = t.where((F.col("type") == "word") & ~F.coalesce(F.col("last") == "redirect", F.lit(False)))
    key = ["spec_id", "sec", "kind", "pkg", "cmd"]
    each = words.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "line_no", plain(F.col("token")).alias("word")))).alias("words"))
    skip = lambda x: x["word"].isin(*_BEFORE) | x["word"].rlike(r"^\w+\+?=")
    head = F.get(F.filter("words", lambda x: ~skip(x)), 0)
    named = each.where(F.exists("words", lambda x: ~skip(x))).withColumn("head", head)
    rest = F.transform(F.filter("words", lambda x: x["pos"] > F.col("head.pos")), lambda x: x["word"])
    out = named.select(*key, F.col("head.line_no").alias("line_no"), (F.element_at("words", 1)["pos"] == F.col("head.pos")).alias("lead"), F.col("head.word").alias("name"), rest.alias("args"))
    return out.withColumn("nth", F.row_number().over(Window.partitionBy("spec_id", "sec", "line_no").orderBy("cmd")))


def first_argument(args):
    """The first argument that is no option."""
    return F.get(F.filter(args, lambda a: ~F.startswith(a, F.lit("-"))), 0)
