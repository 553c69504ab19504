"""Quality rules with native functions: distribution divergence from language references.

A text's character-class histogram and its common-word histogram (counts of the languages' common words, and all
other words as one bin) are compared with those of each language by Jensen-Shannon distance (base 2). A language's
common words are the `vocabulary` words of up to `short` characters that most of its documents have, counted over all
documents. The references are sums over all documents of a language that pass the base rules. A text is kept if it passes
the base rules and is near enough to the nearest language in both histograms. Histograms of few words are ragged: the limit
for common words is wider for short texts, and below `least_words` words only character classes count.

Every label with `least_documents` documents has a reference, up to the `most_languages` most frequent ones. Labels make
references only; a text is compared with all of them whatever its own label.

Base rules: at least 50 words, and at most half of the words inside 3-word windows that occur twice or more.
Repeated windows are found inside each row: 64-bit window hashes with their positions are sorted, equal neighbours are
repeats, and covered words are counted. No window leaves its row, so only one small feature row per text is shuffled.

Defined results: a null text has no words and fails the base rules. Without any reference all that pass them
are kept. Repeated rows count and are returned each on its own. Only id, text and language are read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import saved, spread, table

WHITE = r"[\x20\x09-\x0D]+"
CLASSES = ("lower", "upper", "digit", "symbol", "wide", "white", "other")


def _sum(values: Column, kind: str = "long") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, b: a + b)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: int = 30, short: int = 5, most_languages: int = 64, least_documents: int = 20) -> dict[str, list[str]]:
    """By language its common words, from counts over all documents; at most `most_languages` times `vocabulary`."""
    t = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang IS NOT NULL")
    sizes = t.groupBy("lang").count().where(F.col("count") >= least_documents).orderBy(F.desc("count"), "lang").limit(most_languages)
    out: dict[str, list[str]] = {r["lang"]: [] for r in sizes.collect()}
    own = F.array_distinct(F.filter(F.transform(F.filter(words_of(F.col("text")), lambda w: F.length(w) <= short), F.lower), lambda w: F.length(w) <= short))
    seen = t.where(F.col("lang").isin(list(out))).select("lang", F.explode(own).alias("word")).groupBy("lang", "word").count()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    # each task keeps its own most frequent words before they meet
    for r in seen.where(F.col("count") >= 2).withColumn("place", place).where(F.col("place") <= vocabulary).orderBy("lang", "place").collect():
        out[r["lang"]].append(r["word"])
    return out


def features(docs: DataFrame, words: list[str], id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """`(id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common)`.

    Each step that several expressions read is a projection of its own, so it is evaluated once a row. Character
    classes are taken out one after the other, so that each pass reads what the ones before left.
    """
    t = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    names = ["id", "lang"]
    rest, before = F.col("text"), F.length("text")
    t = t.withColumn("n_chars", before)
    for name, pattern in (("lower", "[a-z]+"), ("white", WHITE), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"), ("wide", r"[^\x00-\x7F]+")):
        t = t.withColumn("rest", F.regexp_replace(rest, pattern, "")).withColumn(name, before - F.length("rest")).withColumn("left", F.length("rest"))
        rest, before = F.col("rest"), F.col("left")
    names += ["n_chars", *CLASSES[:-1], "left"]
    blank = F.lit(" \t\x0b\x0c\r")
    t = t.select(*names, words_of(F.col("text")).alias("words"), F.filter(F.split("text", "\n"), lambda x: F.btrim(x, blank) != "").alias("lines"))
    t = t.select(*names, "words", F.size("words").alias("n"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"))
    names += ["n", "n_dup_lines"]
    # hashes of all windows; texts in which none is repeated, which is most, skip what follows
    windows = F.slice("words", F.lit(1), F.greatest(F.col("n") - 2, F.lit(0)))
    t = t.withColumn("hashes", F.transform(windows, lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    keys = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)
    forms = sorted({f for w in words for f in (w, w[:1].upper() + w[1:], w.upper())})
    held = F.filter("words", lambda w: w.isin(forms)) if forms else F.array().cast("array<string>")
    known = set(words)
    named = F.sort_array(F.filter(F.transform(held, F.lower), lambda w: w.isin(sorted(known)))) if forms else held
    t = t.select(*names, keys.alias("keys"), named.alias("named"))
    beside = lambda x, i: F.coalesce(F.get("keys", i)["h"] == x["h"], F.lit(False))
    twice = F.filter("keys", lambda x, i: beside(x, i + 1) | beside(x, i - 1))
    begun = F.filter(F.transform("named", lambda w, i: F.when(F.coalesce(F.get("named", i - 1) != w, F.lit(True)), i)), lambda i: i.isNotNull())
    t = t.select(*names, "named", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("starts"), begun.alias("begun"))
    # a covered word is counted at the first window over it
    covered = _sum(F.transform("starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - p, F.lit(3))).cast("long")))
    common = F.transform("begun", lambda p, i: F.struct(F.get("named", p).alias("word"), (F.coalesce(F.get("begun", i + 1), F.size("named")) - p).alias("n")))
    return t.select(
        "id", "lang", F.col("n").cast("long").alias("n_words"), (F.col("n_chars") - F.col("white")).cast("long").alias("word_chars"), F.col("symbol").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"), F.array(*[F.col(c) for c in CLASSES[:-1]], F.col("left")).alias("classes"), common.alias("common"),
    )


def base_failed(least_words: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(found: DataFrame, vocabulary: dict[str, list[str]]) -> dict[str, tuple[list[float], dict[str, float]]]:
    """By language: shares of character classes and of its common words, over all documents that pass.

    The result has at most one row for each language and word of the vocabulary.
    """
    passed = found.where(~base_failed() & F.col("lang").isin(list(vocabulary)))
    sums = passed.groupBy("lang").agg(F.sum("n_words").alias("words"), *[F.sum(F.col("classes")[i]).alias(c) for i, c in enumerate(CLASSES)])
    words = passed.select("lang", F.explode("common").alias("c")).groupBy("lang", "c.word").agg(F.sum("c.n").alias("n"))
    out: dict[str, tuple[list[float], dict[str, float]]] = {}
    total = {}
    for r in sums.collect():
        chars = sum(r[c] for c in CLASSES) or 1
        out[r["lang"]], total[r["lang"]] = ([r[c] / chars for c in CLASSES], {}), r["words"]
    for r in words.collect():
        out[r["lang"]][1][r["word"]] = r["n"] / total[r["lang"]]
    return out


def _term(p: Column, q: Column) -> Column:
    """What one bin adds to twice the Jensen-Shannon divergence."""
    part = lambda a: F.when(a > 0, a * F.log2(2 * a / (p + q))).otherwise(F.lit(0.0))
    return part(p) + part(q)


def distances(known: dict[str, tuple[list[float], dict[str, float]]]) -> Column:
    """`array<struct<name, c, w>>`: each language's distance of the character classes, and of the common words.

    References are constants that the optimiser makes of one text, so the plan is as large for many languages as for one.
    """
    names = sorted(known)
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    words = sorted({w for _, own in known.values() for w in own})
    shares = constant([known[n][0] for n in names], "array<array<double>>")
    table_ = constant({w: [known[n][1].get(w, 0.0) for n in names] for w in words}, "map<string,array<double>>")
    sums = constant([sum(known[n][1].values()) for n in names], "array<double>")
    chars = F.greatest(_sum(F.transform("classes", lambda x: x.cast("long"))), F.lit(1).cast("long"))
    n_words = F.greatest(F.col("n_words"), F.lit(1).cast("long"))
    root = lambda x: F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / 2)))
    present = F.transform("common", lambda c: F.struct((c["n"] / n_words).alias("p"), F.try_element_at(table_, c["word"]).alias("q")))
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

    def of(k: Column) -> Column:
        by_class = _sum(F.transform("classes", lambda x, i: _term(x / chars, F.get(F.get(shares, k), i))), "double")
        q = lambda x: F.coalesce(F.get(x["q"], k), F.lit(0.0))
        all_q = F.get(sums, k)
        # words that don't occur add their reference share; all other words are one bin
        by_word = F.aggregate(
            present, zero, lambda s, x: F.struct((s["d"] + _term(x["p"], q(x))).alias("d"), (s["p"] + x["p"]).alias("p"), (s["q"] + q(x)).alias("q")),
            lambda s: s["d"] + all_q - s["q"] + _term(F.greatest(1 - s["p"], F.lit(0.0)), F.greatest(1 - all_q, F.lit(0.0))),
        )
        return F.struct(F.get(constant(names, "array<string>"), k).alias("name"), root(by_class).alias("c"), root(by_word).alias("w"))

    return F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), of)


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", least_words: int = 100, most_class: float = 0.25, most_common: float = 0.1, noise: float = 2.8, vocabulary: int = 30, short: int = 5, most_languages: int = 64, least_documents: int = 20) -> DataFrame:
    """Features with `base_failed`, the nearest language's `reference`, `class_distance`, `common_distance`, `kept`.

    Few words give a ragged histogram, so the common words' limit is `most_common + noise / sqrt(n_words)`, from
    `least_words` words on.
    """
    common = common_words(docs, text, lang, vocabulary, short, most_languages, least_documents)
    found = saved(features(docs, sorted({w for own in common.values() for w in own}), id, text, lang))
    known = references(found, common)
    judged = found.withColumn("base_failed", base_failed())
    limit = F.lit(most_common) + noise / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    if not known:
        none = F.lit(None)
        judged = judged.select("*", none.cast("string").alias("reference"), none.cast("double").alias("class_distance"), none.cast("double").alias("common_distance"), (~F.col("base_failed")).alias("kept"))
    else:
        judged = judged.withColumn("limit", limit).withColumn("far", distances(known))
        near = F.array_min(F.transform("far", lambda x: F.struct((x["c"] / most_class + x["w"] / F.col("limit")).alias("sum"), x["name"].alias("name"), x["c"].alias("c"), x["w"].alias("w"))))
        judged = judged.withColumn("near", near)
        judged = judged.select("*", F.col("near.name").alias("reference"), F.col("near.c").alias("class_distance"), F.col("near.w").alias("common_distance")).drop("near", "far")
        few = F.col("n_words") < least_words
        judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("class_distance") <= most_class) & (few | (F.col("common_distance") <= F.col("limit")))).drop("limit")
    return judged.withColumnRenamed("id", id)


def query(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)
), repeated AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n > 1) GROUP BY doc_id),
languages AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 20 ORDER BY count(*) DESC, lang LIMIT 64),
frequent AS (
  SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place FROM (
    SELECT DISTINCT doc_id, lang, lower(x) AS word FROM (SELECT doc_id, lang, unnest(w) AS x FROM d WHERE lang IN (FROM languages)) WHERE length(x) <= 5 AND length(lower(x)) <= 5)
  GROUP BY lang, word HAVING count(*) >= 2
), vocabulary AS (SELECT DISTINCT word FROM frequent WHERE place <= 30),
b AS (
  SELECT d.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, length(text) AS n_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, length(regexp_replace(text, '[^a-z]', '', 'g')) AS c1,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS c2, length(regexp_replace(text, '[^0-9]', '', 'g')) AS c3, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS c5
  FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN repeated ON repeated.doc_id = d.doc_id
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols AS c4, n_chars - word_chars AS c6,
    n_chars - c1 - c2 - c3 - n_symbols - c5 - (n_chars - word_chars) AS c7 FROM b
), common AS (
  SELECT doc_id, word, count(*) AS n FROM (
    SELECT doc_id, lower(y) AS word FROM (SELECT doc_id, unnest(w) AS y FROM d)
    WHERE y IN (SELECT unnest([word, upper(word[1]) || word[2:], upper(word)]) FROM vocabulary))
  WHERE word IN (FROM vocabulary) GROUP BY doc_id, word
), sums AS (
  SELECT lang, sum(n_words) AS words, sum(c1) AS c1, sum(c2) AS c2, sum(c3) AS c3, sum(c4) AS c4, sum(c5) AS c5, sum(c6) AS c6, sum(c7) AS c7
  FROM f WHERE NOT base_failed AND lang IN (FROM languages) GROUP BY lang
), known AS (
  SELECT f.lang, word, sum(n) AS n FROM common JOIN f ON f.doc_id = common.doc_id WHERE NOT base_failed AND f.lang IN (FROM languages) GROUP BY f.lang, word
), pairs AS (
  SELECT f.doc_id, s.lang, c.n / CAST(greatest(f.n_words, 1) AS DOUBLE) AS p, coalesce(k.n, 0) / CAST(s.words AS DOUBLE) AS q
  FROM f CROSS JOIN sums s CROSS JOIN vocabulary v LEFT JOIN common c ON c.doc_id = f.doc_id AND c.word = v.word
  LEFT JOIN known k ON k.lang = s.lang AND k.word = v.word WHERE c.n > 0 OR k.n > 0
), bins AS (
  SELECT doc_id, lang, coalesce(p, 0) AS p, q, 2 AS kind FROM pairs
  UNION ALL SELECT doc_id, lang, greatest(0, 1 - sum(coalesce(p, 0))), greatest(0, 1 - sum(q)), 2 FROM pairs GROUP BY doc_id, lang
  UNION ALL SELECT doc_id, lang, x[1] / greatest(x[3], 1), x[2] / greatest(x[4], 1), 1 FROM (
    SELECT f.doc_id, s.lang, unnest([[CAST(f.c1 AS DOUBLE), s.c1, tf, ts], [f.c2, s.c2, tf, ts], [f.c3, s.c3, tf, ts], [f.c4, s.c4, tf, ts], [f.c5, s.c5, tf, ts], [f.c6, s.c6, tf, ts], [f.c7, s.c7, tf, ts]]) AS x
    FROM (SELECT *, c1 + c2 + c3 + c4 + c5 + c6 + c7 AS tf FROM f) f CROSS JOIN (SELECT *, c1 + c2 + c3 + c4 + c5 + c6 + c7 AS ts FROM sums) s)
), far AS (
  SELECT doc_id, lang, kind, sqrt(least(1, greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS x
  FROM bins GROUP BY doc_id, lang, kind
), near AS (
  SELECT f.doc_id, a.x AS class, b.x AS common, 0.1 + 2.8 / sqrt(greatest(f.n_words, 1)) AS most,
    row_number() OVER (PARTITION BY f.doc_id ORDER BY a.x / 0.25 + b.x / (0.1 + 2.8 / sqrt(greatest(f.n_words, 1))), a.lang) AS place
  FROM f JOIN far a ON a.doc_id = f.doc_id AND a.kind = 1 JOIN far b ON b.doc_id = f.doc_id AND b.lang = a.lang AND b.kind = 2
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (near.place IS NULL OR (class <= 0.25 AND (n_words < 100 OR common <= most))) AS kept
FROM f LEFT JOIN near ON near.doc_id = f.doc_id AND place = 1
"""
