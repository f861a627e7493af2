"""The registered queries over the driver's tables, and the same in DuckDB SQL.

The tables' texts are normalised already, so queries about normalisation put marks into them first (`dirty`), on both
sides, that every rule has to remove.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import config
from corpusloom.functions import hashing, planning, requests, text
from corpusloom.operators import bpe_training, corpus, dedup, evaluation, overlap, packing, repetition, report, runs, sampling
from corpusloom.runtime import UNKNOWN, materialize, plan_bytes, scratch, ship
from corpusloom.sources import jsonl, suites, tokens
from corpusloom.streaming import jobs, pages

VAL_RATIO = 0.05
BLOCK = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def dirty(docs: DataFrame) -> DataFrame:
    """Text with a decomposed letter, control characters, blank lines and white space at the ends; how many of them depends on doc_id."""
    marks = F.concat(F.lit("\u3000\t e\u0301\x07"), F.col("text"), F.repeat(F.lit("\n"), (F.col("doc_id") % 5).cast("int")), F.lit("x\x01\u00a0\n"))
    return docs.withColumn("text", marks)


_SPACE = " || ".join(f"chr({c})" for low, high in config.WHITE_SPACE_POINTS for c in range(low, high + 1))
_DIRTY = "(chr(12288) || chr(9) || ' e' || chr(769) || chr(7) || text || repeat(chr(10), (doc_id % 5)::INT) || 'x' || chr(1) || chr(160) || chr(10))"


def _norm(column: str) -> str:
    """SQL of normalize_text."""
    return f"trim(regexp_replace(regexp_replace(nfc_normalize({column}), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_SPACE})"


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s]+'), lambda w: w <> '')"


def _distinct(n: int) -> str:
    grams = f"list_transform(range(1, len(w) - {n} + 2), lambda i: w[i : i + {n - 1}])"
    return f"CASE WHEN len(w) >= {n} THEN len(list_distinct({grams})) / len({grams})::DOUBLE ELSE 0.0 END"


_RANGE = {i: "CASE " + " ".join(f"WHEN n_words <= {r[0]} THEN {r[i]}" for r in config.HUMAN_RANGES[:-1]) + f" ELSE {config.HUMAN_RANGES[-1][i]} END" for i in (1, 2, 3)}
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# normalisation, hashes, dedup, split


@query(f"SELECT doc_id, md5({_norm(_DIRTY)}) AS norm_md5, length({_norm(_DIRTY)})::BIGINT AS n_chars, strlen({_norm(_DIRTY)})::BIGINT AS n_bytes FROM documents")
def normalize_documents(spark, sf_dir):
    docs = dirty(documents(spark, sf_dir))
    return docs.select("doc_id", text.normalize_text(F.col("text")).alias("n")).select("doc_id", F.md5(F.col("n").cast("binary")).alias("norm_md5"), text.char_length(F.col("n")).alias("n_chars"), text.byte_length(F.col("n")).alias("n_bytes"))


@query(f"SELECT doc_id, length({_norm('text')})::BIGINT AS n_chars FROM documents WHERE length({_norm('text')}) >= 200")
def min_length_filter(spark, sf_dir):
    return corpus.min_length(documents(spark, sf_dir), config.CORPUS.min_chars).select("doc_id", text.char_length(F.col("norm")).alias("n_chars"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_norm('text')}")
def exact_dedup_keep_first(spark, sf_dir):
    return dedup.exact_dedup(documents(spark, sf_dir)).select("doc_id")


@query(f"SELECT doc_id FROM documents EXCEPT SELECT min(doc_id) FROM documents GROUP BY {_norm('text')}")
def duplicate_documents(spark, sf_dir):
    return dedup.duplicates(documents(spark, sf_dir))


_SPLIT = f"CASE WHEN ('0x' || substr(md5(norm), 1, 8))::BIGINT / 4294967296.0 < {VAL_RATIO} THEN 'val' ELSE 'train' END"
_KEPT = f"SELECT doc_id, text, norm, {_SPLIT} AS split FROM (SELECT *, {_norm('text')} AS norm FROM documents) QUALIFY row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1"


@query(f"""WITH kept AS ({_KEPT}), n AS (SELECT split, (strlen(text) + 2)::BIGINT AS n FROM kept)
SELECT (SELECT count(*) FROM documents)::BIGINT AS n_in, ((SELECT count(*) FROM documents) - count(*))::BIGINT AS n_duplicates, count(*)::BIGINT AS n_kept,
  coalesce(sum(n) FILTER (split = 'train'), 0)::BIGINT AS train_tokens, coalesce(sum(n) FILTER (split = 'val'), 0)::BIGINT AS val_tokens, sum(n)::BIGINT AS n_tokens FROM n""")
def pack_stats_by_split(spark, sf_dir):
    """Bytes stand in for tokens."""
    return dedup.pack_stats(documents(spark, sf_dir), VAL_RATIO, text.byte_length(F.col("text")))


@query(f"""WITH kept AS ({_KEPT}) SELECT round(100.0 * ((SELECT count(*) FROM documents) - count(*)) / (SELECT count(*) FROM documents), 9)::DOUBLE AS duplicate_pct,
  round(sum(strlen(text) + 2)::DOUBLE / {config.TRAIN.target_tokens}, 12)::DOUBLE AS attained FROM kept""")
def duplicate_rate(spark, sf_dir):
    stats = dedup.pack_stats(documents(spark, sf_dir), VAL_RATIO, text.byte_length(F.col("text")))
    return stats.select(F.round(100.0 * F.col("n_duplicates") / F.col("n_in"), 9).alias("duplicate_pct"), F.round(F.col("n_tokens") / F.lit(float(config.TRAIN.target_tokens)), 12).alias("attained"))


@query(f"WITH kept AS ({_KEPT}) SELECT split, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM kept GROUP BY split")
def split_counts(spark, sf_dir):
    return dedup.split_documents(dedup.exact_dedup(documents(spark, sf_dir)), VAL_RATIO).groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(f"""WITH s AS (SELECT md5(text) AS h, {_SPLIT} AS split FROM (SELECT text, {_norm('text')} AS norm FROM documents)), sides AS (SELECT h, count(DISTINCT split) AS n, min(split) AS split FROM s GROUP BY h)
SELECT count(*) FILTER (n > 1)::BIGINT AS shared, count(*) FILTER (n = 1 AND split = 'train')::BIGINT AS train_texts, count(*) FILTER (n = 1 AND split = 'val')::BIGINT AS val_texts FROM sides""")
def split_disjoint(spark, sf_dir):
    """Texts of both splits, of train alone, of val alone: copies of a text stay on one side."""
    docs = dedup.split_documents(documents(spark, sf_dir), VAL_RATIO).withColumn("h", hashing.md5_hash(F.col("text")))
    sides = docs.groupBy("h").agg(F.countDistinct("split").alias("n"), F.min("split").alias("split"))
    alone = lambda split: F.count(F.when((F.col("n") == 1) & (F.col("split") == split), 1))
    return sides.agg(F.count(F.when(F.col("n") > 1, 1)).alias("shared"), alone("train").alias("train_texts"), alone("val").alias("val_texts"))


@query()
def split_blake2b(spark, sf_dir):
    ship(spark)
    docs = documents(spark, sf_dir).withColumn("h", hashing.blake2b_hash(text.normalize_text(F.col("text"))))
    return docs.select("doc_id", "h", hashing.split_of(F.col("h"), VAL_RATIO).alias("split"))


# budgets, hold-outs, inventory


@query("""SELECT doc_id, bytes FROM (SELECT doc_id, strlen(text)::BIGINT AS bytes, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  row_number() OVER (ORDER BY doc_id) AS nth FROM documents) WHERE before < 1000000 OR nth = 1""")
def corpus_byte_budget(spark, sf_dir):
    return corpus.byte_budget(documents(spark, sf_dir), 1_000_000).select("doc_id", "bytes")


@query("""WITH after AS (SELECT doc_id, bytes FROM (SELECT doc_id, strlen(text)::BIGINT AS bytes, sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  row_number() OVER (ORDER BY doc_id) AS nth FROM documents) WHERE nth > 1 AND before >= 1000000 ORDER BY doc_id LIMIT 50)
SELECT * FROM after UNION ALL SELECT * FROM (SELECT doc_id, strlen(text)::BIGINT AS bytes FROM documents ORDER BY doc_id DESC LIMIT 50) WHERE NOT EXISTS (SELECT 1 FROM after)""")
def holdout_skip_sample(spark, sf_dir):
    return corpus.skip_then_sample(documents(spark, sf_dir), 1_000_000, 50).select("doc_id", "bytes")


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes FROM documents ORDER BY doc_id DESC LIMIT 50")
def holdout_fallback_tail(spark, sf_dir):
    return corpus.skip_then_sample(documents(spark, sf_dir), 10**18, 50).select("doc_id", "bytes")


@query(f"""SELECT doc_id, before::BIGINT AS before FROM (SELECT doc_id, coalesce(sum(strlen(n)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  row_number() OVER (ORDER BY doc_id) AS nth FROM (SELECT doc_id, {_norm('text')} AS n FROM documents) WHERE length(n) >= 200 AND doc_id % 7 <> 0) WHERE before < 800000 AND nth <= 300""")
def ingest_budgeted(spark, sf_dir):
    """Documents whose id is divisible by 7 have been ingested before."""
    docs = documents(spark, sf_dir)
    done = docs.where(F.col("doc_id") % 7 == 0)
    return corpus.ingest(docs, min_chars=200, max_bytes=800_000, max_docs=300, done=done).select("doc_id", F.col("before").cast("long").alias("before"))


@query("""SELECT source, count(*)::BIGINT AS n_docs, sum(strlen(text))::BIGINT AS n_bytes, (max(doc_id % 4) + 1)::BIGINT AS next_shard FROM documents GROUP BY source""")
def resume_inventory(spark, sf_dir):
    file = F.format_string("%s_%04d.jsonl", F.col("source"), F.col("doc_id") % 4)
    return jsonl.inventory(documents(spark, sf_dir).withColumn("file", file))


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, strlen(text)::BIGINT AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents),
fold AS (
  SELECT source, doc_id, nth, 0 AS shard, b AS held FROM o WHERE nth = 1
  UNION ALL
  SELECT o.source, o.doc_id, o.nth, CASE WHEN f.held >= 20000 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.held >= 20000 THEN o.b ELSE f.held + o.b END
  FROM fold f JOIN o ON o.source = f.source AND o.nth = f.nth + 1)
SELECT source, doc_id, shard::INT AS shard FROM fold""")
def greedy_shards(spark, sf_dir):
    ship(spark)
    return jsonl.shard_numbers(documents(spark, sf_dir), "source", "doc_id", shard_bytes=20_000).select("source", "doc_id", "shard")


@query("""SELECT doc_id, text FROM (SELECT doc_id, text, doc_id % 6 AS k FROM documents) WHERE k IN (0, 1)""")
def jsonl_lenient(spark, sf_dir):
    """Lines of six kinds made from documents: two texts, broken JSON, a number for text, no text, a blank line."""
    docs = documents(spark, sf_dir)
    good = F.to_json(F.struct("text"))
    k = F.col("doc_id") % 6
    line = F.when(k <= 1, good).when(k == 2, F.lit('{"text": "cut')).when(k == 3, F.lit('{"text": 1}')).when(k == 4, F.lit('{"other": "x"}')).otherwise(F.lit("  "))
    return jsonl.parse_lenient(docs.select("doc_id", line.alias("value"))).select("doc_id", "text")


@query("""SELECT doc_id + 1 AS line_no, CASE doc_id % 6 WHEN 2 THEN 'malformed JSON' WHEN 3 THEN 'missing or not a string' WHEN 4 THEN 'not an object' WHEN 5 THEN 'blank' END AS fault
FROM documents WHERE doc_id % 6 >= 2""")
def jsonl_strict_violations(spark, sf_dir):
    docs, k = documents(spark, sf_dir), F.col("doc_id") % 6
    line = F.when(k <= 1, F.to_json(F.struct("text"))).when(k == 2, F.lit('{"text": "cut')).when(k == 3, F.lit('{"text": 1}')).when(k == 4, F.lit("[1]")).otherwise(F.lit('{"text": " \\t"}'))
    return jsonl.violations(docs.select((F.col("doc_id") + 1).alias("line_no"), line.alias("value")))


@query("""SELECT line_no, fault FROM (SELECT row_number() OVER (ORDER BY doc_id) AS line_no, CASE doc_id % 6 WHEN 2 THEN 'malformed JSON' WHEN 3 THEN 'missing or not a string' WHEN 4 THEN 'not an object' END AS fault FROM documents)
WHERE fault IS NOT NULL""")
def strict_scan_of_files(spark, sf_dir):
    """Lines of six kinds made from documents, written in order of doc_id as the files of one folder and scanned strictly: the refused ones with their numbers. Blank lines are passed over and counted."""
    docs, k, path = documents(spark, sf_dir), F.col("doc_id") % 6, scratch(spark, "strict-scan")
    line = F.when(k <= 1, F.to_json(F.struct("text"))).when(k == 2, F.lit('{"text": "cut')).when(k == 3, F.lit('{"text": 1}')).when(k == 4, F.lit("[1]")).otherwise(F.lit("  "))
    docs.select("doc_id", line.alias("value")).orderBy("doc_id").select("value").write.text(path)
    return jsonl.violations(jsonl.numbered_lines(spark, path))


@query(f"SELECT count(*)::BIGINT AS docs, sum(strlen(n))::BIGINT AS text_bytes FROM (SELECT {_norm(_DIRTY)} AS n FROM documents) WHERE n <> ''")
def jsonl_sink(spark, sf_dir):
    """Documents and bytes of what was written, counted as it is read back."""
    return jsonl.write_jsonl(dirty(documents(spark, sf_dir)), scratch(spark, "jsonl"))


@query("""SELECT source, shard::INT AS shard, file_no::INT AS file_no, count(*)::BIGINT AS n, sum(strlen(text))::BIGINT AS n_bytes FROM (SELECT source, text, doc_id % 3 AS shard, dense_rank() OVER (ORDER BY source || '_' || (doc_id % 3)) - 1 AS file_no FROM documents WHERE source <> '') GROUP BY ALL""")
def corpus_files_in_order(spark, sf_dir):
    """A corpus of three files a source, read as one and counted by file in the order of their names."""
    path = scratch(spark, "corpus")
    docs = documents(spark, sf_dir).where("source <> ''").withColumn("file", F.concat_ws("_", "source", (F.col("doc_id") % 3)))
    write_named(docs.select("file", F.to_json(F.struct("text")).alias("value")), path)
    read = jsonl.read_corpus(spark, path).withColumn("name", F.regexp_replace("file", r"\.jsonl$", ""))
    found = read.groupBy("name", "file_no").agg(F.count("*").alias("n"), F.sum(text.byte_length(F.col("text"))).alias("n_bytes"))
    return found.select(F.substring_index("name", "_", 1).alias("source"), F.substring_index("name", "_", -1).cast("int").alias("shard"), "file_no", "n", "n_bytes")


def write_named(lines, path):
    """Write lines (file, value) as path/<file>.jsonl, one file each; for small corpora."""
    spark = lines.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    lines.repartition("file").write.partitionBy("file").text(f"{path}-parts")
    root = jvm.org.apache.hadoop.fs.Path(f"{path}-parts")
    system = root.getFileSystem(conf)
    system.mkdirs(jvm.org.apache.hadoop.fs.Path(path))
    for folder in system.listStatus(root):
        name = folder.getPath().getName().partition("=")
        if name[1]:
            (part,) = [f.getPath() for f in system.listStatus(folder.getPath())]
            system.rename(part, jvm.org.apache.hadoop.fs.Path(f"{path}/{name[2]}.jsonl"))


@query(f"SELECT count(*)::BIGINT AS docs, sum(strlen({_norm('text')}))::BIGINT AS text_bytes, 1::BIGINT AS sources FROM documents WHERE doc_id % 10 = 0 AND {_norm('text')} <> ''")
def held_out_set(spark, sf_dir):
    """A held-out set written from one source, a folder of files that must not change meanwhile, and read back."""
    path = scratch(spark, "held-out")
    docs = documents(spark, sf_dir).where(F.col("doc_id") % 10 == 0)
    docs.select(F.to_json(F.struct("text")).alias("value")).write.text(f"{path}-source")
    done = jsonl.held_out(docs, path, f"{path}-source/*.txt")
    return spark.range(1).select(F.lit(done["docs"]).cast("long").alias("docs"), F.lit(done["text_bytes"]).cast("long").alias("text_bytes"), F.lit(len(done["folders"])).cast("long").alias("sources"))


@query("SELECT item_id::VARCHAR AS id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS \"group\", text FROM benchmark QUALIFY row_number() OVER (PARTITION BY text ORDER BY item_id) = 1")
def locked_suite(spark, sf_dir):
    """A locked prompt suite, written as JSON and read with its marks checked."""
    path = scratch(spark, "suite")
    items = dedup.keep_first(table(spark, sf_dir, "benchmark"), F.col("text"), "item_id")
    prompt = F.struct(F.col("item_id").cast("string").alias("id"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("group"), F.col("text"))
    marks = [F.lit("final").alias("purpose"), F.lit(False).alias("used_for_sampling_tuning"), F.lit(True).alias("eligible_for_final_claims"), F.lit("run").alias("run_config_fingerprint")]
    items.agg(F.collect_list(prompt).alias("prompts")).select(F.to_json(F.struct(*marks, "prompts")).alias("value")).write.text(path)
    return suites.read_final_suite(spark, path, "run")


@query(f"""SELECT 7::INT AS checkpoint_step, count(*)::BIGINT AS n_docs, sum(strlen(text))::BIGINT AS n_tokens, round(avg(strlen(text)), 6)::DOUBLE AS nll, (SELECT count(*) FROM conversations)::BIGINT AS n_samples, (SELECT round(avg((turn % 2)::DOUBLE), 6) FROM conversations)::DOUBLE AS eos_rate FROM documents""")
def release_figures(spark, sf_dir):
    """Two artifacts written as JSON, read, put through every gate and joined; documents and turns stand in for what was measured."""
    path = scratch(spark, "artifacts")
    one = lambda x, name: x.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(f"{path}/{name}")
    measured = documents(spark, sf_dir).agg(F.count("*").alias("n_docs"), F.sum(text.byte_length(F.col("text"))).alias("n_tokens"), F.round(F.avg(text.byte_length(F.col("text"))), 6).alias("nll"), F.lit(2.0).alias("perplexity"))
    loss = measured.select(F.lit("final_human_loss").alias("purpose"), F.lit(True).alias("eligible_for_final_claims"), F.lit(7).alias("checkpoint_step"), F.lit("c").alias("checkpoint_fingerprint"), F.lit("t").alias("tokenizer_fingerprint"), F.struct(F.lit(0).alias("n_overlap")).alias("separation"), F.struct(*report.LOSS).alias("result"))
    means = [F.lit(0.5).alias(c) for c in report.GENERATION[2:5]]
    turns = table(spark, sf_dir, "conversations").agg(F.count("*").alias("n_samples"), F.round(F.avg((F.col("turn") % 2).cast("double")), 6).alias("eos_rate"), *means, F.lit(3).alias("max_4gram_repeat"))
    run = F.struct(F.lit(7).alias("checkpoint_step"), F.lit("c").alias("checkpoint_fingerprint"), F.lit("t").alias("tokenizer_fingerprint")).alias("run")
    generation = turns.select(F.lit("final").alias("purpose"), F.lit(True).alias("eligible_for_final_claims"), F.lit(False).alias("used_for_sampling_tuning"), F.struct(F.lit(0).alias("exact_prompt_hits")).alias("contamination"), run, F.struct(*report.GENERATION).alias("summary"))
    one(loss, "loss")
    one(generation, "generation")
    joined = report.release_report(report.read_artifact(spark, f"{path}/generation"), report.read_artifact(spark, f"{path}/loss"), step=7, checkpoint="c")
    return joined.select("checkpoint_step", "n_docs", "n_tokens", "nll", "n_samples", "eos_rate")


# streams over the tables


#: Bytes, as the optimizer estimates them, of one file of a stream's source; a batch takes as many files that no task of its shuffle gets much more.
FILE_BYTES = 16 << 20


def file_count(rows, least):
    """Files of FILE_BYTES that rows make, but `least` or more."""
    size = plan_bytes(rows)
    return max(least, -(-size // FILE_BYTES) if size < UNKNOWN else 0)


def arriving(rows, path, batches):
    """Write rows as the files of a stream's source; returns how many of them a batch takes, so that they come in `batches` batches or, if these would be large, in more."""
    files = file_count(rows, batches)
    rows.repartition(files).write.parquet(path)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(files // batches, 2 * tasks))


@query(f"SELECT doc_id, length({_norm('text')})::BIGINT AS n_chars FROM documents WHERE length({_norm('text')}) >= 200")
def stream_ingest(spark, sf_dir):
    """The ingest job run to the end of its source, twice: the second run finds nothing new."""
    path = scratch(spark, "stream-ingest")
    each = arriving(documents(spark, sf_dir).select("doc_id", "text"), f"{path}/in", 2)
    for _ in range(2):
        jobs.ingest(spark, f"{path}/in", "doc_id long, text string", f"{path}/out", f"{path}/log", min_chars=200, files_per_batch=each).awaitTermination()
    return spark.read.schema("doc_id long, text string").parquet(f"{path}/out").select("doc_id", text.char_length(F.col("text")).alias("n_chars"))


@query("SELECT doc_id % 7 AS page, md5(text) AS h, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def stream_pages(spark, sf_dir):
    """Pages of documents read by the paged source: four are there at first, three come before a second run goes on from the checkpoint. Each text once for each document that has it."""
    path = scratch(spark, "stream-pages")
    docs = documents(spark, sf_dir)
    # a page is a file or, if it would be large, several: their names say their place
    files = file_count(docs, 7)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(-(-files // 7)))
    docs = docs.select("text", (F.col("doc_id") % 7).alias("page"), salt.alias("salt"))
    for names in ("page < 4", "page >= 4"):
        docs.where(names).repartition(files, "page", "salt").drop("salt").write.mode("overwrite").partitionBy("page").parquet(f"{path}/made")
        pages.gather(spark, f"{path}/made", f"{path}/in", "page")
        stream = pages.read_pages(spark, f"{path}/in")
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    read = spark.read.schema(pages.SCHEMA).parquet(f"{path}/out")
    number = F.regexp_extract("page", r"^page-(\d+)-", 1).cast("long")
    return read.groupBy(number.alias("page"), hashing.md5_hash(F.col("text")).alias("h")).agg(F.count("*").alias("n"))


@query(f"SELECT md5(n) AS h, length(n)::BIGINT AS n_chars FROM (SELECT DISTINCT {_norm('text')} AS n FROM documents)")
def stream_first_seen(spark, sf_dir):
    """Each text once, whichever batch brings it."""
    path = scratch(spark, "stream-first")
    each = arriving(documents(spark, sf_dir).select("doc_id", "text"), f"{path}/in", 3)
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", each).parquet(f"{path}/in")
    jobs.keep_first_seen(stream, f"{path}/out", f"{path}/log").awaitTermination()
    return spark.read.schema("doc_id long, text string, h string").parquet(f"{path}/out").select("h", text.char_length(text.normalize_text(F.col("text"))).alias("n_chars"))


@query("""SELECT user_id AS run, event_id AS step, value AS loss FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def stream_latest_snapshot(spark, sf_dir):
    """The newest row of each run, batch after batch."""
    path = scratch(spark, "stream-latest")
    schema = "run long, step long, loss double"
    each = arriving(log(spark, sf_dir).select("run", "step", "loss"), f"{path}/in", 3)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(f"{path}/in")
    jobs.latest_snapshot(stream, f"{path}/log", f"{path}/checkpoint").awaitTermination()
    return jobs.read_latest(spark, f"{path}/log").select("run", "step", "loss")


@query("""SELECT conv_id, string_agg(text, '' ORDER BY turn) AS whole FROM (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL) GROUP BY conv_id""")
def stream_incremental_decode(spark, sf_dir):
    """Turns as pieces of seven bytes, decoded as they come and put together again."""
    path = scratch(spark, "stream-decode")
    turns = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "").alias("whole"))
    data = turns.select("conv_id", F.encode("whole", "UTF-8").alias("b")).where(F.octet_length("b") > 0)
    size = F.ceil(F.octet_length("b") / 7)
    cut = data.select("conv_id", "b", size.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("seq"))
    pieces = cut.select("conv_id", "seq", F.substring(F.col("b"), (F.col("seq") * 7 + 1).cast("int"), F.lit(7)).alias("piece"), (F.col("seq") == F.col("n") - 1).alias("last"))
    ship(spark)
    pieces.write.parquet(f"{path}/in")  # the stream takes all files in one batch
    stream = spark.readStream.schema("conv_id long, seq long, piece binary, last boolean").parquet(f"{path}/in")
    jobs.incremental_decode(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    deltas = spark.read.schema("conv_id long, seq long, delta string").parquet(f"{path}/out")
    joined = deltas.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda d: d["delta"]), "").alias("whole"))
    return turns.select("conv_id").join(joined, "conv_id", "left").select("conv_id", F.coalesce("whole", F.lit("")).alias("whole"))


# packing and windows


@query(f"""WITH kept AS ({_KEPT}) SELECT doc_id, split, strlen(text)::BIGINT AS n_tokens,
  coalesce(sum(strlen(text)) OVER (PARTITION BY split ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS token_offset FROM kept""")
def packed_offsets(spark, sf_dir):
    kept = dedup.split_documents(dedup.exact_dedup(documents(spark, sf_dir)), VAL_RATIO)
    out = packing.packed_offsets(kept.select("doc_id", "split", text.byte_length(F.col("text")).alias("b")), F.col("b"), ["split"])
    return out.select("doc_id", "split", "n_tokens", F.col("token_offset").cast("long").alias("token_offset"))


def word_ids():
    """A word's length stands in for its id."""
    return text.wrap_special(F.transform(text.words(F.col("text")), F.length), 1, 2)


@query(f"""WITH ids AS (SELECT doc_id, [1] || list_transform({_WORDS}, lambda w: length(w)::INT) || [2] AS t FROM documents),
flat AS (SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS p, t FROM (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS k FROM ids)),
n AS (SELECT (count(*) - 1) // {BLOCK} AS w FROM flat)
SELECT (p // {BLOCK})::BIGINT AS window_id, sum(t * (p % {BLOCK} + 1))::BIGINT AS x_sum, sum(u * (p % {BLOCK} + 1))::BIGINT AS y_sum, count(*)::BIGINT AS n
FROM (SELECT p, t, lead(t) OVER (ORDER BY p) AS u FROM flat), n WHERE p // {BLOCK} < n.w GROUP BY 1""")
def train_windows(spark, sf_dir):
    made = packing.train_windows(documents(spark, sf_dir), word_ids(), BLOCK)
    weighted = lambda c: F.aggregate(F.transform(c, lambda v, i: (v * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    return made.select("window_id", weighted(F.col("x")).alias("x_sum"), weighted(F.col("y")).alias("y_sum"), F.size("x").cast("long").alias("n"))


@query(f"""WITH ids AS (SELECT doc_id, [1] || list_transform({_WORDS}, lambda w: length(w)::INT) || [2] AS t FROM documents)
SELECT doc_id, s::BIGINT AS start, least({BLOCK}, len(t) - 1 - s)::BIGINT AS n, list_sum(t[s + 1 : s + least({BLOCK}, len(t) - 1 - s)])::BIGINT AS x_sum, list_sum(t[s + 2 : s + 1 + least({BLOCK}, len(t) - 1 - s)])::BIGINT AS y_sum
FROM (SELECT doc_id, t, unnest(range(0, len(t) - 1, {BLOCK})) AS s FROM ids)""")
def eval_windows(spark, sf_dir):
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return packing.eval_windows(documents(spark, sf_dir), word_ids(), BLOCK).select("doc_id", "start", F.size("x").cast("long").alias("n"), total(F.col("x")).alias("x_sum"), total(F.col("y")).alias("y_sum"))


@query("""SELECT step, pos, pos // 37 AS epoch, pos % 37 AS index, pos // 37 + 11 AS seed FROM (SELECT step, unnest(range(step * 8, step * 8 + 8)) AS pos FROM range(5, 40) t(step))""")
def resume_batches(spark, sf_dir):
    """Steps 5..39 of a loader of 37 windows, 8 a step."""
    return packing.positions(spark.range(5, 40).withColumnRenamed("id", "step"), 37, 8, 11)


@query("SELECT i AS number, count(*)::BIGINT AS as_window, count(*)::BIGINT AS as_place FROM range(1000) t(i) GROUP BY i")
def permutation_covers_once(spark, sf_dir):
    """How often each number occurs as a window and as a place."""
    order = packing.permutation(1000, 3, spark)
    both = order.select(F.col("window_id").alias("number"), F.lit(1).alias("w"), F.lit(0).alias("p")).unionByName(order.select(F.col("pos").cast("long").alias("number"), F.lit(0).alias("w"), F.lit(1).alias("p")))
    return both.groupBy("number").agg(F.sum("w").alias("as_window"), F.sum("p").alias("as_place"))


_TRAIN_WINDOWS = SQL["train_windows"]


def train_sums(windows):
    weighted = lambda c: F.aggregate(F.transform(c, lambda v, i: (v * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    return windows.select("window_id", weighted(F.col("x")).alias("x_sum"), weighted(F.col("y")).alias("y_sum"))


@query(f"SELECT window_id, x_sum, y_sum FROM ({_TRAIN_WINDOWS})")
def permuted_windows(spark, sf_dir):
    """The windows of an epoch, looked up in its order: each comes once."""
    made = materialize(packing.train_windows(documents(spark, sf_dir), word_ids(), BLOCK), "windows")
    return train_sums(made.join(packing.permutation(made.count(), 2, spark), "window_id"))


@query(f"SELECT window_id, x_sum, y_sum FROM ({_TRAIN_WINDOWS}) WHERE window_id % 5 = 0")
def token_split_read_back(spark, sf_dir):
    """Windows written as two splits, one of them read back; at least one must be there."""
    made = materialize(packing.train_windows(documents(spark, sf_dir), word_ids(), BLOCK), "windows")
    path = scratch(spark, "token-splits")
    tokens.write_split(made.where("window_id % 5 <> 0"), path, "train", config.TOKENIZER.max_id)
    tokens.write_split(made.where("window_id % 5 = 0"), path, "val", config.TOKENIZER.max_id)
    return train_sums(tokens.require_windows(tokens.load_split(spark, path, "val")))


@query(f"""WITH ids AS (SELECT doc_id, [1] || list_transform({_WORDS}, lambda w: length(w)::INT) || [2] AS t FROM documents), flat AS (SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS p, t FROM (SELECT doc_id, unnest(t) AS t, generate_subscripts(t, 1) AS k FROM ids))
SELECT (p // 4096)::BIGINT AS part, count(*)::BIGINT AS n, sum(t * (p % 4096 + 1))::BIGINT AS weighted FROM flat GROUP BY 1""")
def raw_token_files(spark, sf_dir):
    """Ids written as raw 16-bit files and read back: sums by place in the whole stream."""
    path = scratch(spark, "raw-tokens")
    files = tokens.write_raw(documents(spark, sf_dir).select("doc_id", word_ids().alias("ids")), path, config.TOKENIZER.max_id)
    back = tokens.read_raw(spark, path, 2, chunk=1000).join(F.broadcast(files), "file")  # a row a file
    flat = back.select((F.col("start") + F.col("chunk_no") * 1000).alias("at"), F.posexplode("ids").alias("i", "t")).withColumn("p", F.col("at") + F.col("i"))
    return flat.groupBy(F.floor(F.col("p") / 4096).alias("part")).agg(F.count("*").alias("n"), F.sum(F.col("t") * (F.col("p") % 4096 + 1)).cast("long").alias("weighted"))


@query(f"""WITH ids AS (SELECT doc_id, [1] || list_transform({_WORDS}, lambda w: length(w)::INT) || [2] AS t FROM documents ORDER BY doc_id LIMIT 40)
SELECT doc_id, s::BIGINT AS start FROM (SELECT doc_id, unnest(range(0, len(t) - 1, {BLOCK})) AS s FROM ids) ORDER BY doc_id, s LIMIT 100""")
def eval_windows_limited(spark, sf_dir):
    """The first 100 windows of the first 40 documents."""
    return packing.limited(packing.eval_windows(documents(spark, sf_dir), word_ids(), BLOCK), 100, 40).select("doc_id", "start")


# overlap and contamination


@query(f"""WITH n AS (SELECT doc_id, {_norm('text')} AS t FROM documents), e AS (SELECT * FROM n WHERE doc_id % 10 = 0 AND t <> ''), r AS (SELECT * FROM n WHERE doc_id % 10 <> 0 AND t <> ''),
met AS (SELECT t, min(doc_id) AS pos FROM r WHERE t IN (SELECT t FROM e) GROUP BY t)
SELECT (SELECT count(*) FROM e)::BIGINT AS n_eval, (SELECT count(DISTINCT t) FROM e)::BIGINT AS n_distinct, (SELECT count(*) - count(DISTINCT t) FROM e)::BIGINT AS n_internal,
  (SELECT count(*) FROM met)::BIGINT AS n_overlap, (SELECT count(*) FROM r)::BIGINT AS n_train, (SELECT string_agg(substr(t, 1, 160), '|' ORDER BY pos) FROM (SELECT * FROM met ORDER BY pos LIMIT 5)) AS examples,
  (SELECT count(*) > 0 AND count(*) = count(DISTINCT t) FROM e) AND NOT EXISTS (SELECT 1 FROM met) AS clean""")
def eval_overlap_report(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return overlap.overlap_report(docs.where(F.col("doc_id") % 10 == 0), docs.where(F.col("doc_id") % 10 != 0)).withColumn("examples", F.array_join("examples", "|"))


@query(f"""WITH n AS (SELECT doc_id, {_norm('text')} AS t FROM documents), r AS (SELECT t FROM n WHERE doc_id % 10 <> 0 AND t <> ''), e AS (SELECT t FROM n WHERE doc_id % 10 = 0 AND t <> '' AND t NOT IN (SELECT t FROM r) QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1)
SELECT (SELECT count(*) FROM e)::BIGINT AS n_eval, (SELECT count(DISTINCT t) FROM e)::BIGINT AS n_distinct, (SELECT count(*) FROM e WHERE t IN (SELECT t FROM r))::BIGINT AS n_overlap, (SELECT count(*) FROM r)::BIGINT AS n_train,
  (SELECT count(*) > 0 AND count(*) = count(DISTINCT t) FROM e) AND NOT EXISTS (SELECT 1 FROM e WHERE t IN (SELECT t FROM r)) AS clean""")
def eval_set_cleaned(spark, sf_dir):
    """An evaluation set without its copies and without what train has passes as clean."""
    docs = documents(spark, sf_dir).withColumn("h", hashing.md5_hash(text.normalize_text(F.col("text"))))
    train = docs.where(F.col("doc_id") % 10 != 0)
    held = dedup.exact_dedup(docs.where(F.col("doc_id") % 10 == 0)).join(train.select("h").distinct(), "h", "left_anti")
    report = overlap.overlap_report(held, train)
    overlap.require_clean(report)
    return report.select("n_eval", "n_distinct", "n_overlap", "n_train", "clean")


@query("SELECT count(*)::BIGINT AS n_docs FROM documents")
def final_prompts_unseen(spark, sf_dir):
    """Documents read to make sure that none holds a prompt; here none does, as each prompt carries a mark."""
    needles = table(spark, sf_dir, "benchmark").withColumn("text", F.concat(F.lit("\u2603 "), F.col("text")))
    return spark.range(1).select(F.lit(overlap.require_unseen(needles, documents(spark, sf_dir))).cast("long").alias("n_docs"))


@query(f"""SELECT DISTINCT md5({_norm('text')}) AS h FROM documents WHERE doc_id % 10 = 0 INTERSECT SELECT md5({_norm('text')}) FROM documents WHERE doc_id % 10 <> 0""")
def shared_hashes(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("h", hashing.md5_hash(text.normalize_text(F.col("text"))))
    return docs.where(F.col("doc_id") % 10 == 0).select("h").intersect(docs.where(F.col("doc_id") % 10 != 0).select("h"))


@query(f"""SELECT b.item_id, count(d.doc_id)::BIGINT AS hits, (SELECT count(*) FROM documents)::BIGINT AS n_docs FROM benchmark b
LEFT JOIN documents d ON contains({_norm('d.text')}, {_norm('b.text')}) GROUP BY b.item_id""")
def prompt_containment_hits(spark, sf_dir):
    return overlap.contains_hits(table(spark, sf_dir, "benchmark"), documents(spark, sf_dir))


@query(f"""SELECT b.item_id, count(d.doc_id)::BIGINT AS hits, (SELECT count(*) FROM documents)::BIGINT AS n_docs FROM benchmark b
LEFT JOIN documents d ON contains({_norm('d.text')}, {_norm('substr(b.text, 1, 80)')}) GROUP BY b.item_id""")
def needle_prefix_scan(spark, sf_dir):
    needles = table(spark, sf_dir, "benchmark").withColumn("text", text.prefix(F.col("text"), 80))
    return overlap.contains_hits(needles, documents(spark, sf_dir))


@query(f"""SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND {_norm('text')} IN (SELECT {_norm('text')} FROM documents WHERE doc_id % 2 = 1)""")
def prompt_overlap(spark, sf_dir):
    """Documents stand in for prompts: those of even id are the final ones, the others the diagnostic ones."""
    docs = documents(spark, sf_dir)
    return overlap.prompt_overlap(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id")


@query(f"""WITH p AS (SELECT (conv_id % 300)::VARCHAR AS id, {_norm("coalesce(text, '')")} AS t FROM conversations)
SELECT 'repeated id' AS fault, id AS value FROM p GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'repeated text', t FROM p WHERE t <> '' GROUP BY t HAVING count(*) > 1 UNION ALL SELECT 'empty field', id FROM p WHERE t = ''""")
def prompt_constraints(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return overlap.prompt_faults(turns.select((F.col("conv_id") % 300).cast("string").alias("id"), F.lit("g").alias("group"), "text"))


@query("""SELECT item_id, profile, temperature, top_k::DOUBLE AS top_k, top_p, penalty, seed FROM benchmark,
(VALUES ('default', 0.9::DOUBLE, NULL::INT, 0.92::DOUBLE, 1.05::DOUBLE), ('legacy', 0.8, 50, NULL, 1.0)) p(profile, temperature, top_k, top_p, penalty), (VALUES (1::BIGINT), (2), (3)) s(seed)""")
def prompt_grid(spark, sf_dir):
    """Every prompt with every profile and seed: the two small sides are constants."""
    rows = [(p.name, p.temperature, p.top_k, p.top_p, p.penalty) for p in config.PROFILES]
    listed = F.array(*[F.struct(F.lit(a).alias("profile"), F.lit(b).alias("temperature"), F.lit(c).cast("int").alias("top_k"), F.lit(d).cast("double").alias("top_p"), F.lit(e).alias("penalty")) for a, b, c, d, e in rows])
    seeds = F.array(*[F.lit(s).cast("long") for s in (1, 2, 3)])
    grid = table(spark, sf_dir, "benchmark").select("item_id", F.explode(listed).alias("p")).select("item_id", "p.*", F.explode(seeds).alias("seed"))
    return grid.select("item_id", "profile", "temperature", F.col("top_k").cast("double").alias("top_k"), "top_p", "penalty", "seed")


# repetition

_FOUR = "CASE WHEN len(w) >= 4 THEN (SELECT max(c) FROM (SELECT count(*) AS c FROM (SELECT unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], chr(1)))) AS g) GROUP BY g))::INT ELSE 0 END"
_METRICS = f"SELECT conv_id, turn, role, text, len(w)::INT AS n_words, {_distinct(1)} AS distinct_1, {_distinct(2)} AS distinct_2, {_distinct(4)} AS distinct_4, {_FOUR} AS max_4gram FROM (SELECT *, {_WORDS} AS w FROM conversations)"


@query(f"SELECT conv_id, turn, n_words, round(distinct_1, 9) AS distinct_1, round(distinct_2, 9) AS distinct_2, round(distinct_4, 9) AS distinct_4, max_4gram FROM ({_METRICS})")
def repetition_metrics(spark, sf_dir):
    split = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.words(F.col("text")).alias("w"))
    found = split.select("conv_id", "turn", *[c.alias(n) for n, c in repetition.metrics(F.col("w")).items()])
    return found.select("conv_id", "turn", "n_words", *[F.round(c, 9).alias(c) for c in ("distinct_1", "distinct_2", "distinct_4")], "max_4gram")


@query(f"""SELECT conv_id, turn, {_RANGE[1]}::DOUBLE AS p10, {_RANGE[2]}::DOUBLE AS median, {_RANGE[3]}::DOUBLE AS p90,
  CASE WHEN n_words < 2 THEN 'too short' WHEN distinct_2 < {_RANGE[1]} THEN 'repeating' WHEN distinct_2 > {_RANGE[3]} THEN 'unusually diverse' ELSE 'in range' END AS label,
  CASE WHEN distinct_2 < {_RANGE[1]} THEN 'repeating' WHEN distinct_2 > {_RANGE[3]} THEN 'unusually diverse' ELSE 'in range' END AS label_any, distinct_2 BETWEEN {_RANGE[1]} AND {_RANGE[3]} AS fits FROM ({_METRICS})""")
def repetition_labels(spark, sf_dir):
    split = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.words(F.col("text")).alias("w"))
    found = split.select("conv_id", "turn", F.size("w").alias("n_words"), text.distinct_n(F.col("w"), 2).alias("distinct_2"))
    n, d = F.col("n_words"), F.col("distinct_2")
    low, mid, high = repetition.human_range(n)
    return found.select("conv_id", "turn", low.cast("double").alias("p10"), mid.cast("double").alias("median"), high.cast("double").alias("p90"), repetition.label(d, n).alias("label"), repetition.label(d, n, short=False).alias("label_any"), repetition.in_range(d, n).alias("fits"))


@query(f"""SELECT role, count(*)::BIGINT AS n_samples, round(avg((turn % 2)::DOUBLE), 9) AS eos_rate, round(avg(distinct_1), 9) AS distinct_1_mean, round(avg(distinct_2), 9) AS distinct_2_mean,
  round(avg(distinct_4), 9) AS distinct_4_mean, max(max_4gram)::BIGINT AS max_4gram_repeat FROM ({_METRICS}) GROUP BY role""")
def sample_summary_by_role(spark, sf_dir):
    """The role stands in for the profile, odd turns for samples that ended."""
    return repetition.summary(table(spark, sf_dir, "conversations"), "role", F.col("turn") % 2)


@query(f"""SELECT (CASE WHEN len(w) <= 60 THEN 60 WHEN len(w) <= 120 THEN 120 WHEN len(w) <= 400 THEN 400 ELSE 10000 END)::BIGINT AS max_words, count(*)::BIGINT AS n_docs,
  round(quantile_cont({_distinct(2)}, 0.1), 9) AS p10, round(quantile_cont({_distinct(2)}, 0.5), 9) AS median, round(quantile_cont({_distinct(2)}, 0.9), 9) AS p90
FROM (SELECT {_WORDS} AS w FROM documents) WHERE len(w) >= 2 GROUP BY 1""")
def distinct2_percentiles_by_length(spark, sf_dir):
    return repetition.percentiles(documents(spark, sf_dir))


# tokens


@query(f"""WITH s AS (SELECT sum(length(text))::BIGINT AS n_chars, sum(len({_WORDS}))::BIGINT AS n_tokens, count(*)::BIGINT AS n_docs FROM documents)
SELECT *, round(n_chars / n_tokens::DOUBLE, 9) AS ratio, round(n_chars / n_tokens::DOUBLE - 1.0, 9) AS gain, n_chars / n_tokens::DOUBLE >= 2.4 AS passes FROM s""")
def compression_proxy(spark, sf_dir):
    """Words stand in for tokens."""
    return evaluation.compression(documents(spark, sf_dir), F.size(text.words(F.col("text"))), config.TOKENIZER.compression_gate)


#: The published pattern without its look-ahead, which DuckDB's expressions lack: a mark between the last white space before a word and those before it does the same.
_RE2 = bpe_training.PRETOKEN.replace(r"|\s+(?!\S)", "").replace("'", "''")
_PIECES = rf"SELECT unnest(flatten(list_transform(string_split(regexp_replace(text, '(\s+)(\s\S)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_extract_all(x, '{_RE2}')))) AS piece FROM documents"


@query(f"SELECT piece, count(*)::BIGINT AS n FROM ({_PIECES}) GROUP BY piece")
def pretoken_counts(spark, sf_dir):
    return bpe_training.pretoken_counts(documents(spark, sf_dir))


@query("SELECT doc_id, md5(text) AS decoded_md5, strlen(text)::BIGINT AS n_bytes FROM documents")
def bpe_round_trip(spark, sf_dir):
    """Train a vocabulary of the configured size, encode, decode: the texts that come back."""
    ship(spark)
    docs = documents(spark, sf_dir)
    ranks = bpe_training.train_bpe(docs)
    encode, decode = bpe_training.encode_column(ranks), bpe_training.decode_column(ranks)
    back = docs.select("doc_id", encode("text").alias("ids")).select("doc_id", decode("ids").alias("back"))
    return back.select("doc_id", hashing.md5_hash(F.col("back")).alias("decoded_md5"), text.byte_length(F.col("back")).alias("n_bytes"))


@query()
def bpe_encode_lengths(spark, sf_dir):
    ship(spark)
    docs = documents(spark, sf_dir)
    encode = bpe_training.encode_column(bpe_training.train_bpe(docs))
    return docs.select("doc_id", F.size(text.wrap_special(encode("text"), 1, 2)).cast("long").alias("n_tokens"))


@query("SELECT n_out = 0 AS ok, n FROM (SELECT count(*) FILTER (length(w) > 65535)::BIGINT AS n_out, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents))")
def token_range_check(spark, sf_dir):
    ids = packing.check_range(F.transform(F.split("text", " "), F.length), config.TOKENIZER.max_id)
    return documents(spark, sf_dir).select(F.explode(ids).alias("t")).agg((F.count(F.when(F.col("t") > 65535, 1)) == 0).alias("ok"), F.count("*").alias("n"))


@query("""SELECT vec_id, CASE WHEN list_position(ids, 2) > 0 THEN ids[1 : list_position(ids, 2) - 1] ELSE ids END::VARCHAR AS cut, coalesce(list_position(ids, 2), 0) > 0 AS eos, ids[greatest(1, len(ids) - 9) : len(ids)]::VARCHAR AS last
FROM (SELECT vec_id, list_transform(embedding, lambda x: (floor(abs(x::DOUBLE) * 40))::INT) AS ids FROM embeddings)""")
def cut_at_eos(spark, sf_dir):
    """Scaled components stand in for ids; the end mark is 2."""
    ids = F.transform(F.col("embedding"), lambda x: F.floor(F.abs(x.cast("double")) * 40).cast("int"))
    shown = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    held = table(spark, sf_dir, "embeddings").select("vec_id", ids.alias("ids"))
    return held.select("vec_id", shown(text.cut_at_end(F.col("ids"), 2)).alias("cut"), (F.array_position("ids", 2) > 0).alias("eos"), shown(text.last_block(F.col("ids"), 10)).alias("last"))


# sampling rules: an embedding's components times 20 are the logits of its row


def logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("token_id", "x")).select("row_id", "token_id", (F.col("x").cast("double") * 20).alias("logit"))


_LOGITS = "SELECT vec_id AS row_id, (generate_subscripts(embedding, 1) - 1)::INT AS token_id, unnest(embedding)::DOUBLE * 20 AS logit FROM embeddings"


@query(f"""WITH l AS ({_LOGITS}) SELECT row_id, token_id, round(CASE WHEN token_id % 3 = 0 AND token_id < 30 AND token_id >= 6 THEN CASE WHEN logit < 0 THEN logit * 1.05 ELSE logit / 1.05 END ELSE logit END, 9) AS logit FROM l""")
def apply_repetition_penalty(spark, sf_dir):
    """Context: multiples of 3 below 30, of which the last 8 count."""
    every = logits(spark, sf_dir)
    context = every.select("row_id").distinct().select("row_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("pos")).withColumn("token_id", F.col("pos") * 3)
    return sampling.penalize(every, context, 1.05, block=8).select("row_id", "token_id", F.round("logit", 9).alias("logit"))


@query(f"""WITH l AS ({_LOGITS}), t AS (SELECT row_id, token_id, logit / 0.9 AS x FROM l), e AS (SELECT *, exp(x - max(x) OVER (PARTITION BY row_id)) AS e FROM t)
SELECT row_id, token_id, round(e / sum(e) OVER (PARTITION BY row_id), 9) AS p FROM e""")
def temperature_softmax(spark, sf_dir):
    return sampling.softmax(sampling.temper(logits(spark, sf_dir), 0.9)).select("row_id", "token_id", F.round("p", 9).alias("p"))


@query(f"WITH l AS ({_LOGITS}) SELECT row_id, token_id FROM l QUALIFY rank() OVER (PARTITION BY row_id ORDER BY logit DESC) <= 5")
def top_k_filter(spark, sf_dir):
    return sampling.top_k(logits(spark, sf_dir), 5).select("row_id", "token_id")


@query(f"""WITH l AS ({_LOGITS}), e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY row_id)) AS e FROM l), p AS (SELECT *, e / sum(e) OVER (PARTITION BY row_id) AS p FROM e),
c AS (SELECT *, sum(p) OVER (PARTITION BY row_id ORDER BY logit DESC, token_id ROWS UNBOUNDED PRECEDING) - p AS before, row_number() OVER (PARTITION BY row_id ORDER BY logit DESC, token_id) AS nth FROM p)
SELECT row_id, token_id FROM c WHERE before < 0.92 OR nth = 1""")
def top_p_filter(spark, sf_dir):
    return sampling.top_p(logits(spark, sf_dir), 0.92).select("row_id", "token_id")


@query()
def sampled_tokens(spark, sf_dir):
    every = logits(spark, sf_dir)
    return sampling.sample(every, every.where("token_id < 3").select("row_id", F.col("token_id").alias("pos"), "token_id"), config.DEFAULT_PROFILE, seed=7)


@query("""WITH RECURSIVE g AS (SELECT vec_id AS row_id, 0 AS pos, (vec_id % 10)::INT AS token_id FROM embeddings UNION ALL
  SELECT row_id, pos + 1, (SELECT y FROM range(10) t(y) ORDER BY (token_id * 7 + y * 3) % 11 DESC LIMIT 1)::INT FROM g WHERE pos < 6 AND (pos = 0 OR token_id <> 4))
SELECT row_id, pos::INT AS pos, token_id FROM g""")
def generated_tokens(spark, sf_dir):
    """Greedy generation (top 1) of six tokens by a rule of the last token; rows stop at token 4."""
    start = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.lit(0).alias("pos"), (F.col("vec_id") % 10).cast("int").alias("token_id"))

    def scorer(context):
        last = context.groupBy("row_id").agg(F.max_by("token_id", "pos").alias("x"))
        return last.select("row_id", "x", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("token_id")).select("row_id", "token_id", ((F.col("x") * 7 + F.col("token_id") * 3) % 11).cast("double").alias("logit"))

    greedy = config.SamplingProfile("greedy", 1.0, 1, None, 1.0)
    return sampling.generate(start, scorer, greedy, steps=6, eos=4, block=8, seed=1).select("row_id", "pos", "token_id")


# losses

_PAIRS = f"SELECT doc_id, w[i] AS x, w[i + 1] AS y FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= 2)"
_SCORED = f"""pairs AS ({_PAIRS}), xy AS (SELECT x, y, count(*) AS c FROM pairs WHERE doc_id % 10 <> 0 GROUP BY x, y), cx AS (SELECT x, sum(c) AS cx FROM xy GROUP BY x),
v AS (SELECT count(*) AS v FROM (SELECT x FROM xy UNION SELECT y FROM xy)),
scored AS (SELECT p.doc_id, -ln((coalesce(c, 0) + 1) / (coalesce(cx, 0) + v.v)::DOUBLE) AS ce FROM pairs p LEFT JOIN xy USING (x, y) LEFT JOIN cx USING (x), v WHERE doc_id % 10 = 0)"""


#: Learned from nine tenths of the documents, asked for the other.
_LEARN, _ASK = "doc_id % 10 <> 0", "doc_id % 10 = 0"


@query(f"WITH {_SCORED} SELECT round(avg(ce), 9) AS nll, round(exp(avg(ce)), 6) AS perplexity, count(*)::BIGINT AS n_tokens, count(DISTINCT doc_id)::BIGINT AS n_docs FROM scored")
def nll_bigram(spark, sf_dir):
    docs, words = documents(spark, sf_dir), text.words(F.col("text"))
    loss = evaluation.held_out_loss(evaluation.token_pairs(evaluation.dealt(docs), words), F.expr(_LEARN), F.expr(_ASK))
    return evaluation.token_weighted(loss, n_docs=evaluation.targets(docs.where(_ASK), words))


@query(f"WITH {_SCORED}, b AS (SELECT doc_id // 80 AS b, avg(ce) AS l FROM scored GROUP BY 1) SELECT round(avg(l), 9) AS val_loss, count(*)::BIGINT AS n_batches FROM b")
def validation_loss(spark, sf_dir):
    """Batches of documents by ranges of 80 ids."""
    docs, words = documents(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 80)), text.words(F.col("text"))
    shares = evaluation.batch_shares(docs.where(_ASK), words, "batch")
    pairs = evaluation.token_pairs(evaluation.dealt(docs).join(shares, "batch", "left"), words, "doc_id", "share")
    return evaluation.mean_of_batches(evaluation.held_out_loss(pairs, F.expr(_LEARN), F.expr(_ASK), "share"), shares)


# plans

_T, _M = config.TRAIN, config.MODEL
_STEPS = _T.target_tokens // planning.tokens_per_step(_T, _M)
_PARAMS = "(vocab * width + block * width + layers * (12 * width * width + 2 * width) + width)"
_GRID = "SELECT layers, width, 32000::BIGINT AS vocab, 1024::BIGINT AS block FROM (VALUES (6::BIGINT), (12), (24)) a(layers), (VALUES (512::BIGINT), (768), (1024)) b(width)"


@query(f"""SELECT step, round(CASE WHEN step < {_T.warmup_steps} THEN {_T.lr} * (step + 1) / {_T.warmup_steps} WHEN step >= {_STEPS} THEN {_T.min_lr}
  ELSE {_T.min_lr} + 0.5 * (1 + cos(pi() * (step - {_T.warmup_steps}) / greatest(1, {_STEPS} - {_T.warmup_steps})::DOUBLE)) * ({_T.lr} - {_T.min_lr}) END, 12)::DOUBLE AS lr FROM range(0, {_STEPS + 10}) t(step)""")
def lr_schedule(spark, sf_dir):
    return spark.range(_STEPS + 10).select(F.col("id").alias("step"), F.round(planning.learning_rate(F.col("id"), _STEPS, _T), 12).alias("lr"))


@query(f"""SELECT target, {planning.tokens_per_step(_T, _M)}::BIGINT AS tokens_per_step, (target // {planning.tokens_per_step(_T, _M)})::BIGINT AS steps, round(target / {_T.tokens_per_second}.0 / 3600, 9)::DOUBLE AS hours,
  round(target / {_T.tokens_per_second}.0 / 86400, 9)::DOUBLE AS days, greatest(0, target // {planning.tokens_per_step(_T, _M)} - 20000)::BIGINT AS steps_left FROM (VALUES (1000000000::BIGINT), (2200000000), (5000000000)) t(target)""")
def training_plan(spark, sf_dir):
    each = planning.tokens_per_step(_T, _M)
    target = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in (10**9, 22 * 10**8, 5 * 10**9)])).alias("target"))
    steps = F.floor(F.col("target") / each).cast("long")
    hours = F.col("target") / F.lit(float(_T.tokens_per_second)) / 3600
    left, _ = planning.remaining(F.lit(20_000), steps, hours)
    return target.select("target", F.lit(each).cast("long").alias("tokens_per_step"), steps.alias("steps"), F.round(hours, 9).alias("hours"), F.round(hours / 24, 9).alias("days"), left.cast("long").alias("steps_left"))


def grid(spark):
    pick = lambda *x: F.explode(F.array(*[F.lit(v).cast("long") for v in x]))
    return spark.range(1).select(pick(6, 12, 24).alias("layers")).withColumn("width", pick(512, 768, 1024)).withColumn("vocab", F.lit(32_000).cast("long")).withColumn("block", F.lit(1024).cast("long"))


@query(f"SELECT layers, width, {_PARAMS}::BIGINT AS params, format('{{:.1f}}M', {_PARAMS} / 1e6) AS shown FROM ({_GRID})")
def param_count(spark, sf_dir):
    n = planning.parameters(F.col("vocab"), F.col("block"), F.col("layers"), F.col("width"))
    return grid(spark).select("layers", "width", n.cast("long").alias("params"), planning.format_params(n).alias("shown"))


@query(f"SELECT layers, width, round((16 * {_PARAMS} + 8 * block * width * layers * 36 * 2) / 1073741824.0::DOUBLE, 9)::DOUBLE AS vram_gb, round(12 * {_PARAMS} * 4 / 1073741824.0::DOUBLE, 9)::DOUBLE AS disk_gb FROM ({_GRID})")
def vram_estimate(spark, sf_dir):
    n = planning.parameters(F.col("vocab"), F.col("block"), F.col("layers"), F.col("width"))
    vram = planning.vram_gb(n, F.lit(8), F.col("block"), F.col("layers"), F.col("width"))
    return grid(spark).select("layers", "width", F.round(vram, 9).alias("vram_gb"), F.round(planning.checkpoint_gb(n, F.lit(3)), 9).alias("disk_gb"))


@query("""SELECT p AS profile, t::DOUBLE AS temperature, k::DOUBLE AS top_k, n::DOUBLE AS top_p, r::DOUBLE AS penalty FROM (VALUES ('default', 0.9, NULL, 0.92, 1.05), ('legacy', 0.8, 50, NULL, 1.0)) v(p, t, k, n, r)""")
def profiles(spark, sf_dir):
    return spark.createDataFrame([(p.name, p.temperature, None if p.top_k is None else float(p.top_k), p.top_p, p.penalty) for p in config.PROFILES], "profile string, temperature double, top_k double, top_p double, penalty double")


@query("""SELECT item_id, greatest(1, least(item_id * 37 - 50, 1000))::BIGINT AS n_tokens, greatest(0.01, item_id / 20.0 - 0.5)::DOUBLE AS temperature,
  CASE WHEN item_id % 5 = 4 THEN 'top_p outside [0, 1]' WHEN item_id % 7 = 0 THEN 'top_k below 1' END AS fault FROM benchmark""")
def request_parameters(spark, sf_dir):
    i = F.col("item_id")
    made = F.to_json(F.struct((i * 37 - 50).alias("n_tokens"), (i / F.lit(20.0) - 0.5).alias("temperature"), F.when(i % 5 == 4, 1.5).otherwise(0.9).alias("top_p"), F.when(i % 7 == 0, 0).otherwise(50).alias("top_k"), F.lit("x").alias("unknown")))
    return requests.sanitize(table(spark, sf_dir, "benchmark").select("item_id", made.alias("request"))).select("item_id", "n_tokens", "temperature", "fault")


# run logs: events by user are the log of a run


def log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "ts", F.col("value").alias("loss"))


@query("""SELECT user_id AS run, event_id AS step, round(value, 4) AS loss, round(event_id / (SELECT max(event_id) FROM events)::DOUBLE, 4) AS progress FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def progress_latest(spark, sf_dir):
    rows = log(spark, sf_dir)
    total = rows.agg(F.max("step").alias("total_steps"))
    zero = F.lit(0).cast("long")
    state = rows.crossJoin(total).withColumns({"tokens_seen": zero, "data_position": zero, "best_val_loss": F.lit(float("inf")), "lr": F.lit(0.0), "tokens_per_second": F.lit(0.0), "vram_gb": F.lit(0.0)})
    newest = runs.latest(state, ["run"], "step")
    return newest.select("run", F.struct(*[c for c in newest.columns if c != "run"]).alias("s")).select("run", F.col("s.step").alias("step"), F.round("s.loss", 4).alias("loss"), F.round(F.col("s.step") / F.col("s.total_steps"), 4).alias("progress"))


@query("""SELECT user_id AS run, event_id AS step, min(value) OVER w AS best, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_best(spark, sf_dir):
    return runs.running_best(log(spark, sf_dir), ["run"], ["step"], "loss").select("run", "step", "best", "is_best")


@query("""SELECT run, step, d::DOUBLE AS steps_since, CASE WHEN s > 0 THEN round(65536 * d / s, 6) END AS tokens_per_second FROM (SELECT user_id AS run, event_id AS step, event_id - lag(event_id) OVER w AS d,
  epoch_us(ts)::DOUBLE / 1e6 - lag(epoch_us(ts)::DOUBLE / 1e6) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))""")
def throughput(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    return runs.throughput_rows(log(spark, sf_dir), ["run"], "step", seconds, 65_536).select("run", "step", F.col("steps_since").cast("double").alias("steps_since"), F.round("tokens_per_second", 6).alias("tokens_per_second"))


@query("""SELECT run, step, is_best FROM (SELECT user_id AS run, event_id AS step, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value NULLS LAST, event_id) = 1 AS is_best FROM events) WHERE n <= 3 OR is_best""")
def checkpoint_retention(spark, sf_dir):
    return runs.retained(log(spark, sf_dir), ["run"], 3, "loss").select("run", "step", "is_best")


@query("""SELECT user_id AS run, max(event_id) AS step FROM events WHERE event_type <> 'error' AND value IS NOT NULL GROUP BY user_id""")
def checkpoint_latest_loadable(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "event_type", "value")
    return runs.latest_loadable(rows, ["run"], (F.col("event_type") != "error") & F.col("value").isNotNull()).select("run", "step")


@query("""SELECT event_id AS step, CASE WHEN event_id % 2 = 0 THEN value + 1 ELSE value END AS loss FROM events""")
def checkpoint_upsert(spark, sf_dir):
    rows = log(spark, sf_dir).select("step", "loss")
    return runs.upsert(rows, rows.where("step % 2 = 0").withColumn("loss", F.col("loss") + 1))


@query("""SELECT event_id AS step, printf('step_%07d.pt', event_id) AS file FROM events WHERE event_id % 3 <> 0""")
def checkpoint_rebuild(spark, sf_dir):
    file = F.when(F.col("step") % 3 != 0, F.format_string("step_%07d.pt", F.col("step"))).otherwise(F.lit("notes.txt"))
    return runs.rebuild(log(spark, sf_dir).select(file.alias("file")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise, keep the first of each text, split, and count."""
    return pack_stats_by_split(spark, sf_dir)

