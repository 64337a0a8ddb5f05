"""Chat formatting in budgeted windows, in DataFrame expressions alone.

A turn is written as ``<|turn|>role<|text|>text<|end|>``, a window as ``<s>`` turns ``</s>``. Inside roles
and texts a backslash is doubled and every control string gets a backslash after its first character,
so no control string is left in them and removing one backslash of each restores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Token budget of a window, of which new turns take up to half and repeated history up to a quarter.
BUDGET = 2048

# The control strings of the template and of templates that readers may apply later.
CONTROL = ["<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_PATTERN = "(<)(\\|(?:turn|text|end|im_start|im_end|endoftext)\\|>|/?s>|</?SYS>>)|(\\[)(/?INST\\])"


def escape(col):
    """``col`` without control strings, reversibly."""
    doubled = F.regexp_replace(col, r"\\", r"\\\\")
    return F.regexp_replace(doubled, _PATTERN, r"$1$3\\$2$4")


def unescape(col):
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def windows(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Format conversations (conv_id long, turn long, role, text; other columns are ignored) in windows.

    Turns are put in order of turn, role and text; a null role or text is empty. Tokens of a turn are its
    words ``\\S+`` and three for its marks; prefix sums over the conversation deal turns to windows of up to
    half the budget, never cutting a turn (one that is longer makes its window longer). A window repeats the
    conversation's leading system turn and as much of the turns just before it as fits a quarter of the
    budget; the loss mask covers the texts of its own assistant turns, never repeated ones. Returns
    conv_id, window, formatted, mask (array of start, length in code points) and repeated (number of
    leading repeated turns). A null conv_id is a conversation of its own; an empty table gives no windows.
    """
    half, quarter = budget // 2, budget // 4
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    t = t.withColumn("tokens", F.size(F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")) + 3)
    over = "OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    t = t.withColumn("pos", F.expr(f"count(*) {over}")).withColumn("sum", F.expr(f"sum(tokens) {over}"))
    t = t.withColumn("window", F.floor((F.col("sum") - F.col("tokens")) / half))
    t = t.withColumn("head", (F.col("pos") == 1) & (F.col("role") == "system"))
    # where the prefix sum of a window's own turns starts, to find its history
    t = t.withColumn("open", F.expr("min(sum - tokens) OVER (PARTITION BY conv_id, window)"))
    t = t.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    opens = t.select("conv", "conv_id", "window", "open").distinct()
    own = t.select("conv", "conv_id", "window", "pos", "role", "text", F.lit(False).alias("again"))
    # windows open at least half a budget apart, so a turn can be history of the next window alone
    following = t.where(F.col("window") >= 0).select("conv", "pos", "role", "text", "sum", "tokens", (F.col("window") + 1).alias("window"))
    past = opens.join(following, ["conv", "window"]).where(F.col("open") - F.col("sum") + F.col("tokens") <= quarter)
    past = past.select("conv", "conv_id", "window", "pos", "role", "text", F.lit(True).alias("again"))
    heads = t.where("head").select("conv", "pos", "role", "text", F.lit(True).alias("again"), F.col("window").alias("of"))
    first = opens.join(heads, "conv").where("of < window").select("conv", "conv_id", "window", "pos", "role", "text", "again")
    past = past.unionByName(first).distinct()
    piece = F.concat(F.lit("<|turn|>"), escape(F.col("role")), F.lit("<|text|>"))
    rows = own.unionByName(past).select("conv", "conv_id", "window", "pos", "again", piece.alias("lead"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("target"))
    packed = rows.groupBy("conv", "conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("pos", "again", "lead", "body", "target"))).alias("r"))
    start = "3 + aggregate(slice(r, 1, i), 0, (a, y) -> a + length(y.lead) + length(y.body) + 7) + length(x.lead)"
    mask = f"filter(transform(r, (x, i) -> struct({start} AS start, length(x.body) AS length, x.target AND NOT x.again AS on)), m -> m.on)"
    return packed.select(
        "conv_id",
        "window",
        F.concat(F.lit("<s>"), F.array_join(F.transform("r", lambda x: F.concat(x["lead"], x["body"], F.lit("<|end|>"))), ""), F.lit("</s>")).alias("formatted"),
        F.transform(F.expr(mask), lambda m: F.struct(m["start"], m["length"])).alias("mask"),
        F.size(F.filter("r", lambda x: x["again"])).alias("repeated"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Conversations read from ``windows`` alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    body = F.expr("substring(formatted, 4, length(formatted) - 7)")
    parts = F.filter(F.split(body, r"<\|end\|>"), lambda x: x != "")
    turns = F.transform(
        F.slice("parts", F.col("repeated") + 1, F.greatest(F.size("parts") - F.col("repeated"), F.lit(0))),
        lambda x: F.struct(
            unescape(F.regexp_extract(x, r"(?s)^<\|turn\|>(.*?)<\|text\|>", 1)).alias("role"),
            unescape(F.regexp_extract(x, r"(?s)<\|text\|>(.*)$", 1)).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substring("formatted", m["start"] + 1, m["length"]))), "")
    w = formatted.withColumn("parts", parts).select("conv_id", "window", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))
    w = w.select("conv_id", "window", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"), "loss", "chars")
    c = w.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    said = F.array_join(F.transform("w", lambda x: x["said"]), "")
    lost = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return c.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), "formatted_chars"
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -1, whose texts are made of control strings."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = turns.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(probe)
