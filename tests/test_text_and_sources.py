import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.config import HUMAN_RANGES, WHITE_SPACE, WHITE_SPACE_POINTS
from corpusloom.functions import hashing, requests, text
from corpusloom.operators import greedy, repetition
from corpusloom.operators.dedup import normalize_udf
from corpusloom.sources import jsonl, suites, tokens


def column(spark, values, f):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, text string")
    return [r.v for r in frame.select("i", f(F.col("text")).alias("v")).orderBy("i").collect()]


NFD = unicodedata.normalize("NFD", "Tiếng Việt")


def test_normalize(spark):
    values = [NFD, "a\x00b\x07c", "a\tb\nc", "a\n\n\n\n\nb", "  　x ", "", None, "é\x07x\n\n\n\ny", "\x00"]
    wanted = ["Tiếng Việt", "abc", "a\tb\nc", "a\n\nb", "x", "", None, "éx\n\ny", ""]
    assert column(spark, values, text.normalize_text) == wanted
    assert column(spark, [NFD, None], normalize_udf) == ["Tiếng Việt", None]
    assert column(spark, [f"{c}a{c}" for c in WHITE_SPACE], text.normalize_text) == ["a"] * len(WHITE_SPACE)
    assert sorted(WHITE_SPACE) == sorted(chr(i) for i in range(0x3001) if chr(i).isspace())


def test_words_and_ngrams(spark):
    values = ["a b  c　d", "", None, "one", "a a a a a"]
    assert column(spark, values, text.words) == [["a", "b", "c", "d"], [], [], ["one"], ["a"] * 5]
    frame = spark.createDataFrame([(v,) for v in values], "text string").withColumn("w", text.words(F.col("text")))
    got = frame.select(*[c.alias(n) for n, c in repetition.metrics(F.col("w")).items()]).collect()
    assert tuple(got[4]) == (0.2, 0.25, 0.5, 2, 5) and tuple(got[1]) == (0, 0, 0, 0, 0) and tuple(got[3]) == (1, 0, 0, 0, 1)


def test_words_part_at_all_white_space_and_at_nothing_else(spark):
    spaces = [chr(c) for low, high in WHITE_SPACE_POINTS for c in range(low, high + 1)]
    near = [chr(c) for low, high in WHITE_SPACE_POINTS for c in (low - 1, high + 1) if chr(c) not in spaces] + list("&[]-\\x\u200b\ufeff\U00020000")
    assert column(spark, [s.join(f"{s}ab") + s * 2 for s in spaces], text.words) == [["a", "b"]] * len(spaces)
    assert column(spark, [f"a{s}b" for s in near], text.words) == [[f"a{s}b"] for s in near]


def test_human_ranges(spark):
    n = [1, 60, 61, 400, 401, 10_000, 10**6]
    frame = spark.createDataFrame([(x,) for x in n], "n long")
    low = [r.x for r in frame.select(repetition.human_range(F.col("n"))[0].alias("x")).collect()]
    assert low == [next((r[1] for r in HUMAN_RANGES if x <= r[0]), HUMAN_RANGES[-1][1]) for x in n]
    labels = spark.createDataFrame([(0.963, 120), (0.963, 5000), (0.5, 50), (0.5, 1)], "d double, n long")
    assert [r.x for r in labels.select(repetition.label(F.col("d"), F.col("n")).alias("x")).collect()] == ["in range", "unusually diverse", "repeating", "too short"]


def test_hash_and_split(spark):
    import hashlib

    assert column(spark, ["một", None], hashing.blake2b_hash) == [hashlib.blake2b("một".encode(), digest_size=16).hexdigest(), None]
    frame = spark.range(20_000).select(hashing.split_of(F.md5(F.col("id").cast("string").cast("binary")), 0.05).alias("s"))
    assert 800 < frame.where("s = 'val'").count() < 1200
    assert hashing.fingerprint_json({"b": 1, "a": "é"}) == hashing.fingerprint_json({"a": "é", "b": 1})


def lines(spark, values):
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "line_no long, value string")


def test_lenient_and_strict_jsonl(spark):
    values = ['{"text": "ok"}', "not json", "", '{"text": 1}', '{"other": "x"}', '{"text": ""}', '{"text": null}', '{"text": "b", "n": 2}', '{"text": "cut']
    assert [r.text for r in jsonl.parse_lenient(lines(spark, values)).orderBy("line_no").collect()] == ["ok", "b"]
    with pytest.raises(Exception, match="not a JSON object"):
        jsonl.parse_lenient(lines(spark, ["[1]"])).collect()
    for bad, fault in (("nope", "malformed"), ("[1]", "object"), ('{"text": 2}', "string"), ('{"text": "  "}', "blank")):
        with pytest.raises(ValueError, match=f"line 3: .*{fault}"):
            jsonl.parse_strict(lines(spark, [values[0], "", bad]))
    assert jsonl.parse_strict(lines(spark, [values[0], values[7]])).count() == 2


def test_sink_scan_and_inventory(spark, tmp_path):
    docs = spark.createDataFrame([("a\n\n\n\nb",), (" é ",), ("",), (None,)], "text string")
    row = jsonl.write_jsonl(docs, f"file://{tmp_path}/out").first()
    assert (row.docs, row.text_bytes) == (2, 6)
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "b.jsonl").write_text('{"text": "2"}\nbroken\n')
    (corpus / "a.jsonl").write_text('{"text": "1"}\n')
    (corpus / "c.txt").write_text('{"text": "3"}\n')
    assert {(r.file, r.text) for r in jsonl.read_corpus(spark, f"file://{corpus}").collect()} == {("a.jsonl", "1"), ("b.jsonl", "2")}
    assert [tuple(r) for r in jsonl.numbered_lines(spark, f"file://{corpus}/b.jsonl").collect()][:2] == [(1, '{"text": "2"}'), (2, "broken")]
    files = spark.createDataFrame([("wiki_vi_0000.jsonl", "ab"), ("wiki_vi_0002.jsonl", "é"), ("web_vi_0001.jsonl", "x"), ("web_vi_tmp.jsonl", "y")], "file string, text string")
    assert {tuple(r) for r in jsonl.inventory(files).collect()} == {("wiki_vi", 2, 4, 3), ("web_vi", 1, 1, 2)}
    report = jsonl.held_out(docs, f"file://{tmp_path}/held", f"file://{corpus}")
    assert report["docs"] == 2 and len(report["source"]) == 3


def test_greedy_shards(spark):
    docs = spark.createDataFrame([("s", i, "x" * n) for i, n in enumerate([5, 6, 1, 12, 3])] + [("t", 1, None)], "source string, doc_id long, text string")
    got = {(r.source, r.doc_id): r.shard for r in jsonl.shard_numbers(docs, "source", "doc_id", first=4, shard_bytes=10).collect()}
    assert got == {("s", 0): 4, ("s", 1): 4, ("s", 2): 5, ("s", 3): 5, ("s", 4): 6, ("t", 1): 4}


def fold_shards(rows, shard_bytes):
    """rows (order, bytes) by the definition: a shard closes once it holds shard_bytes."""
    out, shard, held = {}, 0, 0
    for order, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        out[order] = shard
        held += size
        if held >= shard_bytes:
            shard, held = shard + 1, 0
    return out


def test_greedy_shards_over_many_ranges(spark, monkeypatch):
    """Ranges of a few shards each; documents of no bytes, of a shard's bytes and of more than a range's."""
    rng = random.Random(21)
    monkeypatch.setattr(greedy, "RANGE_ROWS", 12)
    rows = [(g, i, rng.choice([0, 0, 1, 3, 9, 10, 11, 25, 400]) if g == "odd" else rng.randint(0, 9)) for g in ("odd", "even", None, "one") for i in ([*range(300), None] if g != "one" else [3])]
    sizes = spark.createDataFrame(rows, "g string, o long, b long")
    got = {(r.g, r.o): r.shard for r in greedy.shard_of_rows(sizes, first=0, shard_bytes=10).collect()}
    wanted = {(g, o): n for g in ("odd", "even", None, "one") for o, n in fold_shards([(o, b) for x, o, b in rows if x == g], 10).items()}
    assert got == wanted
    assert max(wanted.values()) > 100
    assert greedy.shard_of_rows(sizes.limit(0), first=0, shard_bytes=10).collect() == []


def test_leaps():
    import numpy as np

    rng = np.random.default_rng(3)
    sums = np.unique(np.cumsum(rng.integers(0, 30, 500)))
    leave, count = greedy.leaps(sums, 70)
    for i in range(0, len(sums), 17):
        starts = greedy.starts_from(sums, int(sums[i]), 70)
        assert (count[i], leave[i]) == (len(starts), starts[-1] + 70)


def test_token_table(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    windows = spark.createDataFrame([(0, [1, 2], [2, 3])], "window_id long, x array<int>, y array<int>")
    tokens.write_split(windows, path, "train", 65_535)
    assert tokens.load_split(spark, path, "train").count() == 1 and tokens.load_split(spark, path, "val").count() == 0
    assert tokens.load_split(spark, f"{path}-none", "val").collect() == []
    with pytest.raises(ValueError):
        tokens.require_windows(tokens.load_split(spark, path, "val"))
    for bad in ([1, 2, 65_536], [1, -1]):
        with pytest.raises(Exception, match="outside 0..65535"):
            tokens.write_split(spark.createDataFrame([(0, bad, [1])], windows.schema), path, "val", 65_535)


def test_suites(spark, tmp_path):
    good = {"purpose": "final", "used_for_sampling_tuning": False, "eligible_for_final_claims": True, "run_config_fingerprint": "f", "prompts": [{"id": "1", "group": "g", "text": "một"}, {"id": "2", "group": "g", "text": "hai"}]}
    path = tmp_path / "suite.json"
    for change, fails in (({}, None), ({"purpose": "draft"}, "not locked"), ({"used_for_sampling_tuning": True}, "not locked"), ({"run_config_fingerprint": "x"}, "another run")):
        path.write_text(json.dumps(good | change))
        if fails:
            with pytest.raises(ValueError, match=fails):
                suites.read_final_suite(spark, f"file://{path}", "f")
        else:
            assert suites.read_final_suite(spark, f"file://{path}", "f").count() == 2
    for prompts in ([{"id": "1", "group": "g", "text": "a"}] * 2, [{"id": "1", "group": "", "text": "a"}], [{"id": "1", "group": "g", "text": " "}], []):
        path.write_text(json.dumps(good | {"prompts": prompts}))
        with pytest.raises(ValueError):
            suites.read_suite(spark, f"file://{path}")


def test_request_parameters(spark):
    asked = ['{"n_tokens": 5000, "temperature": -1}', '{"top_p": 1.5}', '{"top_k": 0}', '{"penalty": 0.5}', '{"unknown": 1, "top_p": 0}', "{}"]
    got = requests.sanitize(spark.createDataFrame([(a,) for a in asked], "request string")).collect()
    assert (got[0].n_tokens, got[0].temperature) == (1000, 0.01)
    assert [r.fault for r in got] == [None, "top_p outside [0, 1]", "top_k below 1", "penalty below 1", None, None]
    assert got[5].n_tokens is None


def test_read_corpus_by_source_prefix(spark, tmp_path):
    for name in ("wiki_vi_0001", "wiki_vi_0002", "wikinews_vi_0001", "w*_0001"):
        (tmp_path / f"{name}.jsonl").write_text(f'{{"text": "{name}"}}\n')
    read = lambda prefix: sorted(r.text for r in jsonl.read_corpus(spark, str(tmp_path), prefix=prefix).collect())
    assert read("wiki_vi_") == ["wiki_vi_0001", "wiki_vi_0002"]
    assert read("w*_") == ["w*_0001"] and len(read("")) == 4


def test_run_spec_and_diagnostic_suite(spark, tmp_path):
    spec = suites.run_spec(checkpoint_step=7, checkpoint_fingerprint="c", seeds=(1, 2), max_new=5)
    assert spec["fingerprint"] == hashing.fingerprint_json({k: v for k, v in spec.items() if k != "fingerprint"})
    assert spec["fingerprint"] != suites.run_spec(checkpoint_step=7, checkpoint_fingerprint="c", seeds=(1, 3), max_new=5)["fingerprint"]
    with pytest.raises(ValueError, match="negative"):
        suites.run_spec(checkpoint_step=7, checkpoint_fingerprint="c", seeds=(1,), max_new=-1)
    suite = {"purpose": "diagnostic", "eligible_for_final_claims": False, "used_for_sampling_tuning": True, "prompts": [{"id": "1", "group": "g", "text": "t"}]}
    (tmp_path / "a.json").write_text(json.dumps(suite))
    assert suites.read_diagnostic_suite(spark, str(tmp_path / "a.json")).count() == 1
    (tmp_path / "b.json").write_text(json.dumps(suite | {"purpose": "final"}))
    with pytest.raises(ValueError, match="diagnostic"):
        suites.read_diagnostic_suite(spark, str(tmp_path / "b.json"))


def test_copies_of(spark, tmp_path):
    for name, data in (("a", "x" * 50), ("b", "y" * 50), ("c", "x" * 50), ("d", "x" * 51)):
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / name).write_text(data)
    (tmp_path / "own").write_text("x" * 50)
    assert sorted(r.path[-1] for r in jsonl.copies_of(spark, str(tmp_path / "files"), str(tmp_path / "own")).collect()) == ["a", "c"]


def test_corpus_files_are_numbered(spark, tmp_path):
    for name in ("b_0002", "a_0001", "b_0001"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"text": name}))
    assert {r.text: r.file_no for r in jsonl.read_corpus(spark, str(tmp_path)).collect()} == {"a_0001": 0, "b_0001": 1, "b_0002": 2}
