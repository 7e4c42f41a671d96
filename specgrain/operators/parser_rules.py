"""What is wrong with a recipe's text before any rule is asked: blocks that don't close, lines and macros that can't be read."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .recipe_rules import at, rule


@rule("parse/E0002", "parse-unterminated-conditional", "deny")
def unterminated_conditional(r):
    """An opening line at a depth that no later line closes before the recipe ends or the depth opens again."""
    w = Window.partitionBy("spec_id", "depth").orderBy("line_no")
    marks = r.lines.where("(opens or closes) and depth > 0").withColumn("after", F.lead("closes").over(w))
    return at(marks.where("opens and not coalesce(after, false)"), F.trim("line"))


@rule("parse/W0001", "parse-stray-percent")
def stray_percent(r):
    """A percent sign that neither is doubled nor begins a macro."""
    text = F.regexp_replace("line", "%%", "")
    return at(r.lines.where(~F.col("line").rlike(r"^\s*#") & text.rlike(r"%(?:[^A-Za-z_0-9{(\[?!*#%-]|$)")), F.trim("line"))


@rule("parse/W0002", "parse-line-not-recognized")
def unrecognized(r):
    """A line of a preamble or package section that is no tag, comment, macro or conditional, nor goes on from such a line."""
    w = Window.partitionBy("spec_id").orderBy("line_no")
    goes_on = r.lines.select("spec_id", "line_no", F.lag("line").over(w).endswith("\\").alias("goes_on"))
    line = r.body.where("kind in ('preamble', 'package') and not (opens or closes or turns) and trim(line) <> ''")
    odd = line.where(~F.col("line").rlike(r"^\s*[#%}]|^\s*[A-Za-z][A-Za-z0-9]*\s*(\([^)]*\))?\s*:"))
    return at(odd.join(goes_on, ["spec_id", "line_no"]).where("not coalesce(goes_on, false)"), F.trim("line"))


@rule("parse/W0004", "parse-unterminated-macro")
def unterminated_macro(r):
    """A braced macro in a tag's value that the line doesn't close."""
    count = lambda p: F.size(F.regexp_extract_all("value", F.lit(p), 0))
    return at(r.tags.where((count(r"%\{") > count(r"\}")) | (count(r"%\(") > count(r"\)"))), F.col("value"))


@rule("parse/W0005", "parse-multiple-else")
def multiple_else(r):
    w = Window.partitionBy("spec_id", "depth", "chain").orderBy("line_no")
    b = r.branches.where("how = 'else'").withColumn("n", F.row_number().over(w))
    return at(b.where("n > 1"))


@rule("parse/W0023", "parse-malformed-changelog-header")
def malformed_header(r):
    """Fixed form: * weekday month day [time zone] year. Days that don't exist are another rule's."""
    return at(r.changelog.where("month is null or month = 0 or day is null or year is null"), F.col("rest"))
