"""Chat formatting with native functions: budgeted, turn-aligned windows with loss masks.

Turns are `<|turn|>role<|says|>text<|end|>`. Control strings inside roles and texts are escaped by one more
`~` after `<`, which can be undone exactly: `<|` becomes `<~|`, `<~|` becomes `<~~|`, and so on.

Prefix sums of the turns' tokens choose the windows: a window takes new turns while the system turn, the
history allowance and they fit `budget`; a turn too long for any window has one of its own, whole. Later
windows repeat the system turn and as many of the turns before as fit `history`; repeated turns are marked
`<|again|>` and are not under the loss mask, so each assistant text is learned once.

No task holds a conversation, however long. Windows are chosen from turns without their texts: those are
range-partitioned and written once with their partition number; only the first conversation of a partition can go on from
the one before, so the places and prefix sums that it starts with are one row for each partition. A new window starts at
every `block`th turn, so windows are chosen within blocks of that many turns. Texts then join their turns and are collected
for each window alone.

Defined results: null roles and texts are empty. Turns are ordered by turn and the MD5 of the role's length and both texts, so ties
and repeated rows have a fixed order and all count; null turns come first. Rows with a null conversation id are
one conversation. A turn has at least one token; rows that are alike but for given token counts have the largest. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import saved, table

NEW, AGAIN, SAYS, END = "<|turn|>", "<|again|>", "<|says|>", "<|end|>"
#: What counts as a token where no column gives counts: up to six letters, up to three digits, or one other mark.
TOKEN = r"\p{L}{1,6}|\p{N}{1,3}|[^\x09-\x0D\x20\p{L}\p{N}]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", r"<~$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*)\|", r"<$1|")


def _body(role: Column, text: Column) -> Column:
    return F.concat(escaped(role), F.lit(SAYS), escaped(text), F.lit(END))


def native_tokens(role: Column, text: Column) -> Column:
    """Tokens of both by `TOKEN`, and four for the marks."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("long") + F.regexp_count(role, F.lit(TOKEN)).cast("long") + 4


def placed(turns: DataFrame) -> tuple[DataFrame, bool]:
    """Different turns `(ck, tk, tie, turn, tokens, copies, sys_text)` to a row for each copy with `i`, its place in the
    conversation, and `upto`, tokens up to and with it; and whether any has copies."""
    laid = turns.repartitionByRange("ck", "turn", "tie").sortWithinPartitions("ck", "turn", "tie")
    laid = saved(laid.withColumn("part", F.spark_partition_id()))
    several = not laid.where("copies > 1").isEmpty()
    all_tokens = F.col("copies") * F.col("tokens")
    totals = laid.groupBy("part", "ck").agg(F.sum("copies").alias("n"), F.sum(all_tokens).alias("t"))
    before = Window.partitionBy("ck").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("part", "ck", F.sum("n").over(before).alias("n_before"), F.sum("t").over(before).alias("t_before")).where("n_before > 0")
    own = Window.partitionBy("part", "ck").orderBy("turn", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = laid.withColumn("i", F.sum("copies").over(own) - F.col("copies")).withColumn("upto", F.sum(all_tokens).over(own) - all_tokens)
    # at most one row for each partition
    rows = rows.join(F.broadcast(carry), ["part", "ck"], "left")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)) if several else F.lit(0).cast("long")
    rows = rows.select("*", copy.alias("copy"))
    place = F.col("i") + F.coalesce("n_before", F.lit(0)) + F.col("copy")
    upto = F.col("upto") + F.coalesce("t_before", F.lit(0)) + (F.col("copy") + 1) * F.col("tokens")
    return rows.select("ck", "tk", "tie", "tokens", "sys_text", place.alias("i"), upto.alias("upto")), several


def chosen_windows(rows: DataFrame, budget: int, history: int, system: str, block: int) -> DataFrame:
    """`(ck, block, cuts, first_window, sys_body, sys_tokens)`: first turns of the windows of a block, with tokens before each."""
    first = rows.where((F.col("i") == 0) & F.col("sys_text").isNotNull()).select("ck", _body(F.lit(system), F.col("sys_text")).alias("sys_body"), F.col("tokens").alias("sys_tokens"))
    numbers = F.array_sort(F.collect_list(F.struct("i", "tokens", "upto")))
    blocks = rows.groupBy("ck", F.floor(F.col("i") / block).alias("block")).agg(numbers.alias("turns")).join(first, "ck", "left")
    cut = lambda t: F.struct(t["i"].alias("i"), (t["upto"] - t["tokens"]).alias("before"))
    none = F.lit(0).cast("long")
    kind = "array<array<struct<i:bigint,before:bigint>>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.array(cut(F.col("turns")[0])).alias("now"), F.lit(False).alias("later"), none.alias("used"))
    system_tokens = F.coalesce("sys_tokens", none)

    def step(s: Column, t: Column) -> Column:
        # a conversation's first window has no history, later ones keep room for it
        reserve = F.when((F.col("block") > 0) | s["later"], F.lit(history)).otherwise(F.lit(0))
        counted = F.when((t["i"] == 0) & F.col("sys_tokens").isNotNull(), none).otherwise(t["tokens"])
        full = (s["used"] > 0) & (s["used"] + counted > F.lit(budget) - system_tokens - reserve)
        long = full & (F.size(s["now"]) >= 64)  # appended in parts, so that no long list is copied for each window
        return F.struct(
            F.when(long, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
            F.when(long, F.array(cut(t))).when(full, F.concat(s["now"], F.array(cut(t)))).otherwise(s["now"]).alias("now"),
            (s["later"] | full).alias("later"),
            F.when(full, counted).otherwise(s["used"] + counted).alias("used"),
        )

    cuts = F.aggregate("turns", start, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["now"]))))
    blocks = blocks.select("ck", "block", cuts.alias("cuts"), "sys_body", "sys_tokens")
    earlier = Window.partitionBy("ck").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("first_window", F.coalesce(F.sum(F.size("cuts")).over(earlier), F.lit(0)))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 2048, history: int = 256, system: str = "system", learned: str = "assistant", tokens: str | Callable[[Column, Column], Column] = native_tokens, block: int = 4096) -> DataFrame:
    """`(conv, window, first_turn, n_turns, n_repeated, tokens, formatted, loss_spans)`, one row per window.

    `tokens` names a column with each turn's number of tokens, or makes one of role and text. `loss_spans` are
    (start, length) in characters of `formatted`; `first_turn` counts from 0. History can't reach over more than a block.
    """
    if budget <= 0 or history < 0 or block <= 0:
        raise ValueError("budget and block must be positive and history not negative")
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    given = [F.col(f"`{tokens}`").cast("long").alias("tokens")] if isinstance(tokens, str) else []
    wide = turns.select(F.col(f"`{conv}`").alias("conv"), key(conv).alias("ck"), F.col(f"`{turn}`").alias("turn"), key(turn).alias("tk"), blank(role).alias("role"), blank(text).alias("text"), *given)
    wide = wide.withColumn("tie", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    count = F.col("tokens") if given else tokens(F.col("role"), F.col("text")).cast("long")
    system_text = F.max(F.when(F.col("role") == system, F.col("text")))
    narrow = wide.groupBy("ck", "tk", "tie").agg(F.min("turn").alias("turn"), F.greatest(F.max(count), F.lit(1)).alias("tokens"), F.count("*").alias("copies"), system_text.alias("sys_text"))
    rows, several = placed(narrow)
    windows = chosen_windows(rows, budget, history, system, block)
    texts = wide.select("ck", "tk", "tie", "conv", "role", "text")
    texts = texts.dropDuplicates(["ck", "tk", "tie"]) if several else texts
    own = F.floor(F.col("i") / block)
    # the last turns of a block are history for the next; a turn has a token at least, so no others are
    near = (F.col("i") % block >= block - history) if history else F.lit(False)
    rows = rows.drop("sys_text").select("*", F.explode(F.when(near, F.array(own, own + 1)).otherwise(F.array(own))).alias("block")).join(windows, ["ck", "block"])
    has_system, before = F.col("sys_tokens").isNotNull(), F.col("upto") - F.col("tokens")
    begun = F.size(F.filter("cuts", lambda c: c["i"] <= F.col("i")))
    place = lambda n, kind: F.struct(n.cast("int").alias("n"), F.lit(kind).alias("kind"))
    # kinds: 0 system turn, 1 history, 2 new
    new = F.when(begun > 0, F.array(place(begun - 1, 2))).otherwise(F.array().cast("array<struct<n:int,kind:int>>"))
    leads = has_system & (F.col("i") > 0) & F.coalesce(F.get("cuts", begun - 1)["i"] == F.col("i"), F.lit(False))
    first = F.when(leads, F.array(place(begun - 1, 0))).otherwise(F.array().cast("array<struct<n:int,kind:int>>"))
    numbered = F.transform("cuts", lambda c, n: F.struct(n.alias("n"), c["i"].alias("i"), c["before"].alias("before")))
    later = F.filter(numbered, lambda c: (c["i"] > F.col("i")) & (c["before"] - before <= history) & ~(has_system & (F.col("i") == 0)))
    old = F.transform(later, lambda c: place(c["n"], 1))
    rows = rows.select("ck", "tk", "tie", "i", "tokens", "first_window", "sys_body", "sys_tokens", F.concat(first, old, new).alias("to")).where(F.size("to") > 0)
    rows = rows.join(texts, ["ck", "tk", "tie"]).withColumn("body", _body(F.col("role"), F.col("text"))).withColumn("text_at", F.length(escaped(F.col("role"))) + len(SAYS))
    rows = rows.select("*", F.explode("to").alias("one")).drop("to").withColumnRenamed("one", "to")
    is_system = F.col("to.kind") == 0
    member = F.struct(
        F.when(is_system, F.lit(0)).otherwise(F.col("i")).alias("i"), F.col("to.kind").alias("kind"), F.when(is_system, F.col("sys_body")).otherwise(F.col("body")).alias("body"),
        F.when(is_system, F.col("sys_tokens")).otherwise(F.col("tokens")).alias("tokens"), F.col("text_at"), ((F.col("to.kind") == 2) & (F.col("role") == learned)).alias("learned"),
    )
    number = F.col("first_window") + F.col("to.n")
    grouped = rows.groupBy("ck", number.alias("window")).agg(F.first("conv").alias("conv"), F.array_sort(F.collect_list(member)).alias("turns"))
    mark = lambda t: F.when(t["kind"] == 2, F.lit(NEW)).otherwise(F.lit(AGAIN))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def span(s: Column, t: Column) -> Column:
        from_ = s["at"] + len(NEW) + t["text_at"]
        whole = F.struct(from_.alias("start"), (F.length(t["body"]) - t["text_at"] - len(END)).alias("length"))
        return F.struct((s["at"] + F.length(mark(t)) + F.length(t["body"])).alias("at"), F.when(t["learned"], F.concat(s["spans"], F.array(whole))).otherwise(s["spans"]).alias("spans"))

    fresh = F.filter("turns", lambda t: t["kind"] == 2)
    total = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["tokens"])
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(mark(t), t["body"])), "")
    return grouped.select(F.col("conv").alias(conv), F.col("window").cast("int").alias("window"), fresh[0]["i"].alias("first_turn"), F.size(fresh).alias("n_turns"), (F.size("turns") - F.size(fresh)).alias("n_repeated"), total.alias("tokens"), formatted.alias("formatted"), F.aggregate("turns", start, span, lambda s: s["spans"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The new turns of a formatted window, `array<struct<role, text>>`, unescaped."""
    bodies = F.regexp_extract_all(formatted, F.lit(r"(?s)<\|turn\|>(.*?)<\|end\|>"), 1)
    return F.transform(bodies, lambda b: F.struct(unescaped(F.substring_index(b, SAYS, 1)).alias("role"), unescaped(F.substring_index(b, SAYS, -1)).alias("text")))


def query(spark, sf_dir):
    """Digests of whole conversations, read back from the windows; a digest needs its conversation in one row."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = format_chats(chats.unionByName(hostile))
    read = out.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "formatted", "loss_spans"))).alias("w"))
    turns = F.flatten(F.transform("w", lambda w: read_turns(w["formatted"])))
    masked = F.flatten(F.transform("w", lambda w: F.transform(w["loss_spans"], lambda s: unescaped(F.substring(w["formatted"], s["start"] + 1, s["length"])))))
    chars = F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + F.length(w["formatted"]))
    read = read.select("conv_id", turns.alias("turns"), F.array_join(masked, "").alias("loss"), chars.alias("formatted_chars"))
    turns, texts = F.col("turns"), F.col("loss")
    digest = F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return read.select("conv_id", F.size(turns).cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length(texts).cast("long").alias("loss_chars"), F.sha2(texts, 256).alias("loss_sha256"), "formatted_chars")


def _count(column: str) -> str:
    return f"len(regexp_extract_all({column}, '{TOKEN}'))"


ORACLE_SQL = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, row_number() OVER o - 1 AS i, sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING) AS upto FROM (
    SELECT *, CAST({_count("text")} + {_count("role")} + 4 AS BIGINT) AS tokens,
      length(regexp_replace(role, '<(~*)\|', '<~\1|', 'g')) + length(regexp_replace(text, '<(~*)\|', '<~\1|', 'g')) + 15 AS chars FROM c)
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text))
), s AS (SELECT conv_id, max(CASE WHEN i = 0 AND role = 'system' THEN tokens ELSE 0 END) AS sys FROM t GROUP BY conv_id),
r AS (
  SELECT t.conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS win, CAST(CASE WHEN sys > 0 THEN 0 ELSE tokens END AS BIGINT) AS used FROM t JOIN s ON s.conv_id = t.conv_id WHERE t.i = 0
  UNION ALL
  SELECT t.conv_id, CAST(t.i AS BIGINT),
    CAST(win + CASE WHEN t.i % 4096 = 0 OR used > 0 AND used + tokens > 2048 - sys - CASE WHEN win > 0 THEN 256 ELSE 0 END THEN 1 ELSE 0 END AS BIGINT),
    CAST(CASE WHEN t.i % 4096 = 0 OR used > 0 AND used + tokens > 2048 - sys - CASE WHEN win > 0 THEN 256 ELSE 0 END THEN tokens ELSE used + tokens END AS BIGINT)
  FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1 JOIN s ON s.conv_id = t.conv_id
), w AS (SELECT conv_id, win, min(i) AS start FROM r WHERE win > 0 GROUP BY conv_id, win),
again AS (
  SELECT w.conv_id, sum(t.chars + 9) AS chars FROM w JOIN t b ON b.conv_id = w.conv_id AND b.i = w.start - 1 JOIN s ON s.conv_id = w.conv_id
  JOIN t ON t.conv_id = w.conv_id AND t.i < w.start AND ((sys > 0 AND t.i = 0) OR t.upto - t.tokens >= b.upto - 256) GROUP BY w.conv_id
), f AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars + 8) AS chars FROM t GROUP BY conv_id
)
SELECT f.conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(f.chars + coalesce(again.chars, 0) AS BIGINT) AS formatted_chars
FROM f LEFT JOIN again ON again.conv_id = f.conv_id
"""
