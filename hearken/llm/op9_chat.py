"""Chat formatting with Spark expressions alone.

A conversation's turns are collected as structs and sorted; a fold over the array merges neighbours of one role;
the text is a concatenation over the merged blocks. A block is `### role: part<part>part</turn>` and a line break.
Inside roles and parts a backslash and the three control strings are written as two-character units that begin with
a backslash, so no control string is left in them and every text can be had back.

One conversation is one string of at most 512 million code points (2 GB as four bytes each); that, and not a task's
share of rows, is the limit. The work for a conversation grows with its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TURN, PART = "### ", "</turn>\n", "<part>"
#: Runs of a mask that are summed at a time.
CHUNK = 64
_UNITS = {"###": "\\h", "</turn>": "\\t", PART: "\\p"}


def escape(text: Column, role: bool = False) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, unit in (_UNITS | ({":": "\\c"} if role else {})).items():
        text = F.replace(text, F.lit(plain), F.lit(unit))
    return text


def unescape(text: Column) -> Column:
    """Cut at escaped backslashes, from the left; the units in between are then unmistakable."""

    def units(x: Column) -> Column:
        for plain, unit in (_UNITS | {":": "\\c"}).items():
            x = F.replace(x, F.lit(unit), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), lambda x: units(x)), "\\")


def _once(value: Column) -> Column:
    """value, as something that the optimizer won't move into a function over an array, to be worked out for each element."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask: an array of runs (n code points, loss) that covers formatted in order.

    turns: conv_id, turn, role, text. Null roles and texts are empty; null turns come first and equal turns in order
    of role and text; repeated rows are turns of their own; rows without conv_id are one conversation; other
    columns are ignored; no rows give no conversations. Under the loss are the escaped parts of loss_role.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # where a role begins, from one look at each turn and the one before; then a slice for each block
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    whole = lambda at, i: F.coalesce(F.get("begins", i + 1), F.size("turns")) - at
    blocks = F.transform("begins", lambda at, i: F.struct(F.get("turns", at)["role"].alias("role"), F.transform(F.slice("turns", at + 1, whole(at, i)), lambda t: t["text"]).alias("parts")))
    head = lambda b: F.concat(F.lit(HEAD), escape(b["role"], True), F.lit(": "))
    run = lambda n, loss: F.struct(n.alias("n"), loss.alias("loss"))
    block = lambda b: F.concat(head(b), F.array_join(F.transform(b["parts"], lambda p: escape(p)), PART), F.lit(TURN))
    mask = lambda b: F.concat(
        F.array(run(F.length(head(b)), F.lit(False))),
        F.flatten(F.transform(b["parts"], lambda p, i: F.array(run(F.when(i > 0, len(PART)).otherwise(0), F.lit(False)), run(F.length(escape(p)), b["role"] == loss_role)))),
        F.array(run(F.lit(len(TURN)), F.lit(False))),
    )
    merged = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).withColumn("turns", _once(F.col("turns"))).withColumn("begins", _once(begins)).select("conv_id", _once(blocks).alias("blocks"))
    return merged.select("conv_id", F.array_join(F.transform("blocks", block), "").alias("formatted"), F.flatten(F.transform("blocks", mask)).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and loss_texts (one per run under the loss), from formatted and mask alone."""
    blocks = F.split(F.col("formatted"), TURN, -1)
    role = lambda b: F.substring_index(F.substr(b, F.lit(len(HEAD) + 1)), ": ", 1)
    body = lambda b: F.substr(b, F.length(role(b)) + F.lit(len(HEAD) + 3))
    turns = F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), lambda b: F.transform(F.split(body(b), PART, -1), lambda p: F.struct(unescape(role(b)).alias("role"), unescape(p).alias("text")))))
    # offsets are running sums in two steps, over chunks and within one; the text is cut as four bytes a code point, since a
    # string is walked through from its start for each cut
    n = F.transform("loss_mask", lambda r: r["n"])
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("loss_mask") - 1) / CHUNK).cast("int")), lambda g: F.slice(n, g * CHUNK + 1, CHUNK))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    d = formatted.withColumn("chunks", _once(chunks)).withColumn("sums", _once(F.transform("chunks", total)))
    d = d.withColumn("bases", _once(F.transform("sums", lambda _, g: total(F.slice("sums", F.lit(1), g)))))
    inside = lambda c, g: F.transform(c, lambda x, i: F.get("bases", g) + total(F.slice(c, F.lit(1), i)))
    d = d.withColumn("starts", _once(F.flatten(F.transform("chunks", inside)))).withColumn("wide", _once(F.encode("formatted", "UTF-32")))
    spans = F.filter(F.arrays_zip("loss_mask", "starts"), lambda s: s["loss_mask"]["loss"])
    # a mark of byte order before each cut, for one that the text begins with would be taken for it
    cut = lambda s: F.decode(F.concat(F.unhex(F.lit("0000FEFF")), F.substring("wide", s["starts"].cast("int") * 4 + 1, s["loss_mask"]["n"] * 4)), "UTF-32")
    under = F.transform(spans, lambda s: unescape(cut(s)))
    return d.select("conv_id", "formatted", turns.alias("turns"), under.alias("loss_texts"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each formatted conversation."""
    back = read_back(format_conversations(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
