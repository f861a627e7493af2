"""Importance resampling towards a target distribution, over hashed word runs.

A document's features are its runs of one to three words, each hashed to one of BUCKETS buckets. A bucket's gain is the
logarithm of how much commoner it is in the target than in the corpus; a document's weight is the sum over its
features, and a Gumbel draw that depends on doc_id alone turns the highest scores into a sample without replacement.

All of it is DataFrame functions. A document's buckets are one array, made by higher-order functions, and its weight is
an aggregate over that array that looks each bucket up in a literal array of BUCKETS gains: no row a feature, no join.
What is shuffled is a count for each task and bucket, and of the scored rows those that the cut may reach.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialize

#: Buckets that features are hashed to, and the longest run of words that is one feature.
BUCKETS, LONGEST = 10_000, 3
#: What stands between words, ASCII signs, white space and control characters; A-Z are lower-cased before.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of text, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def buckets(found: Column) -> Column:
    """The bucket of each run of 1 to LONGEST consecutive words, one array: found is evaluated once, as a lambda's argument."""
    place = lambda run: (F.crc32(run.cast("binary")) % BUCKETS).cast("int")

    def with_next(run: Column, w: Column, more: int) -> Column:
        return F.transform(run, lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + more)))

    def runs(w: Column) -> Column:
        spread = [w]
        for more in range(1, LONGEST):  # a run of more words is the one before with the word after it, but for the last
            spread.append(with_next(F.slice(spread[-1], 1, F.greatest(F.size(w) - more, F.lit(0))), w, more))
        return F.transform(F.concat(*spread), place)

    return F.flatten(F.transform(F.array(found), runs))


def hashed(docs: DataFrame) -> DataFrame:
    """docs with n_words and buckets, the text left out."""
    split = F.transform(F.array(words(F.col("text"))), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), buckets(w).alias("buckets")))
    return docs.select(*[c for c in docs.columns if c not in ("text", "n_words", "buckets")], F.inline(split))


def counts(rows: DataFrame) -> list[int]:
    """How many features fall into each bucket; BUCKETS numbers come to the driver, whatever the table's size."""
    found = rows.select(F.explode("buckets").alias("b")).groupBy("b").count().collect()
    out = [0] * BUCKETS
    for r in found:
        out[r["b"]] = r["count"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """For each bucket floor(1000 * ln of its smoothed share in the target over that in the corpus)."""
    s_all, t_all = sum(corpus), sum(target)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)))) for s, t in zip(corpus, target, strict=True)]


def weight(of: Column, gain: list[int]) -> Column:
    """The sum of the gains of an array of buckets. The gains are one literal, parsed once when the plan is made."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<long>")
    return F.aggregate(of, F.lit(0).cast("long"), lambda total, b: total + F.element_at(table, b + 1))


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) for a u in (0, 1) that comes from the seed and doc_id alone; a null doc_id counts as empty text."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(head, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def with_rank(scored: DataFrame, able: Column, drawn: int, of: int) -> DataFrame:
    """scored (doc_id, score, _at: a number of its own for each row) with rank: 1 to drawn for the rows with the highest scores among the `of` able ones, ties to the smaller doc_id (null last) and then to the smaller _at; null for the others.

    Only rows from a quantile below the cut on are sorted, by ranges of (score, doc_id, _at): as _at differs, equal
    scores and ids can be cut anywhere. A row's rank is its place in its range behind the sizes of the ranges before.
    """
    if not drawn:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    low = scored.where(able).approxQuantile("score", [max(0.0, 1 - drawn / of - 0.01)], 0.002)[0]
    near = F.coalesce(able & (F.col("score") >= low), F.lit(False))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_at")]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # monotonically_increasing_id: the partition's number above 33 bits of the row's place in it
    ordered = scored.where(near).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ordered = materialize(ordered.withColumn("_part", F.shiftright("_m", 33)), "ranked")
    behind, before = {}, 0
    for part, n in sorted((r["_part"], r["count"]) for r in ordered.groupBy("_part").count().collect()):  # a row a range
        behind[part], before = before, before + n
    first = F.create_map(*[F.lit(x).cast("long") for item in behind.items() for x in item])
    place = F.element_at(first, F.col("_part")) + F.col("_m").bitwiseAND((1 << 33) - 1) + 1
    ranked = ordered.withColumn("rank", F.when(place <= drawn, place)).drop("_m", "_part")
    return ranked.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs (doc_id, text; other columns are not looked at).

    target (text) is what the sample should look like. Of the N rows with at least least_words words, those of the
    floor(percent * N / 100) highest scores are drawn and ranked from 1, ties to the smaller doc_id; rank is null for
    the others. Null and empty texts have no features, weight 0 and a score as any other. Rows that repeat a doc_id
    are rows of their own with the same draw; a null doc_id comes after the others in a tie. Whole texts are hashed,
    however long. An empty table gives no rows; with an empty target, a document's weight tells how rare its
    features are in the corpus.
    """
    rows = materialize(hashed(docs.select("doc_id", "text")), "buckets")
    gain = gains(counts(rows), counts(hashed(target.select("text"))))
    scored = rows.select("doc_id", F.size("buckets").cast("long").alias("n_features"), "n_words", weight(F.col("buckets"), gain).alias("weight"))
    scored = materialize(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("_at", F.monotonically_increasing_id()), "scores")
    able = F.col("n_words") >= least_words
    of = scored.where(able).count()
    return with_rank(scored, able, percent * of // 100, of).select("doc_id", "n_features", "weight", "score", "rank")


def op11(spark, sf_dir: str) -> DataFrame:
    """resample of documents towards benchmark. Nulls, empty texts, ties, repeated rows and empty tables as there."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _register(value: int, bits: int) -> int:
    """A crc32 register after `bits` more zero bits; the polynomial is the usual one, lowest bit first."""
    for _ in range(bits):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes, four bits at a time, the lower four of a byte first."""
    digits = f"hex(encode({text}))"
    nibbles = f"list_transform(range(0, strlen({digits})), lambda i: (instr('0123456789ABCDEF', substr({digits}, xor(i, 1) + 1, 1)) - 1)::BIGINT)"
    step = f"xor(c >> 4, list_extract({[_register(x, 4) for x in range(16)]}, (xor(c, x) & 15) + 1))"
    return f"xor(4294967295, list_reduce({nibbles}, lambda c, x: {step}, 4294967295::BIGINT))"


def _features_sql(table: str, key: str) -> str:
    """DuckDB SQL: key, a run of words, of every feature of a table."""
    found = f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"
    runs = [f"SELECT {key}, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS run FROM ({found})" for n in range(1, LONGEST + 1)]
    return " UNION ALL ".join(runs)


OP11_SQL = f"""
WITH found AS MATERIALIZED ({_features_sql("documents", "doc_id")}),
wanted AS MATERIALIZED ({_features_sql("benchmark", "item_id")}),
hashed AS MATERIALIZED (
    SELECT run, {crc32_sql("run")} % {BUCKETS} AS b FROM (SELECT run FROM found UNION SELECT run FROM wanted)
),
buckets AS MATERIALIZED (
    SELECT b.b, coalesce(s.n, 0) AS s, coalesce(t.n, 0) AS t
    FROM (SELECT unnest(range(0, {BUCKETS})) AS b) b
    LEFT JOIN (SELECT b, count(*) AS n FROM found JOIN hashed USING (run) GROUP BY b) s USING (b)
    LEFT JOIN (SELECT b, count(*) AS n FROM wanted JOIN hashed USING (run) GROUP BY b) t USING (b)
),
gain AS MATERIALIZED (
    SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS g FROM buckets
),
weights AS (SELECT doc_id, count(*) AS n_features, sum(g)::BIGINT AS weight FROM found JOIN hashed USING (run) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
    SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score,
        coalesce(n_features, 0) >= 57 AS able
    FROM documents d LEFT JOIN weights USING (doc_id)
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * n // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n FROM scored)
"""
