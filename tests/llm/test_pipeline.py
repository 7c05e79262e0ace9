"""The pipeline's stages against brute force on the smallest tables, each on its own input."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def stages(spark, data):
    from legispark.llm.storage import materialize

    docs, out = spark.read.parquet(f"{data}/documents.parquet"), {}
    out["input"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, data), name)
        out[name] = docs.collect()
    return out


def test_columns_stay(stages):
    want = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name][0].__fields__ == want
    assert stages["sharding"][0].__fields__ == [*want, "size", "shard", "slot"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


def test_toxicity_keeps_clean_documents(stages, spark, data):
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages["toxicity"]}
    clean = [r.doc_id for r in stages["input"] if marks.get(r.doc_id) == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_near_dedup(stages):
    sets = {}
    for r in stages["toxicity"]:
        w = SPACE_WORD.findall((r.text or "").translate(LOWER))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert {r.doc_id for r in stages["near_dedup"]} == {i for i in ids if root(i) == i}


def test_decontamination(stages, spark, data):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    windows = set()
    for b in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        v = split(b.text)
        windows |= {tuple(v[k : k + 10]) for k in range(max(1, len(v) - 9) if v else 0)}
    sizes = {len(w) for w in windows}

    def hit(text):
        w = split(text)
        return any(tuple(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1))

    assert {r.doc_id for r in stages["decontamination"]} == {r.doc_id for r in stages["near_dedup"] if not hit(r.text)}


def test_mixing_takes_whole_copies(stages):
    before = {r.doc_id: r for r in stages["decontamination"]}
    count = {}
    for r in stages["mixing"]:
        assert r == before[r.doc_id]
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert max(count.values()) <= 3


def test_sharding(stages):
    rows = stages["sharding"]
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stages["mixing"])
    by = {}
    for r in rows:
        assert r["size"] == len((r.text or "").encode()) + 16
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def made(spark, tmp_path, rows, schema):
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    item = " ".join(f"b{k}" for k in range(12))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return spark.createDataFrame(rows, schema), item


@pytest.mark.parametrize("broadcast", [250_000, 0])
def test_awkward_rows(spark, tmp_path, broadcast, monkeypatch):
    """Nulls, rows alike, ids that rows share, and columns with the names that the stages use."""
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", broadcast)
    names = "_gone long, copies long, _key long, _row long, _turn long, _size long, _hash long, _id long, size long, _plan0 long, _copy long, task long, label int"
    schema = f"doc_id long, text string, lang string, source string, {names}"
    item = " ".join(f"b{k}" for k in range(12))
    plain = [(1, "one two three four five six", "en", "a"), (2, "seven eight nine", None, "b"), (2, "other text here", None, "b"), (3, None, "en", None), (3, "", "en", None), (None, "no id at all", "en", "a"), (None, f"x {item}", "en", "a"), (4, f"{item} y", "en", "a"), (4, "clean words of four", "en", "a")]
    plain += [(5, "the same row again and again", "en", "a")] * 60
    rows = [(*r, *range(13)) for r in plain]
    docs, _ = made(spark, tmp_path, rows, schema)
    stage = dict(corpus_pipeline.STAGES)
    whole = lambda df: sorted(map(str, df.collect()))
    assert whole(stage["toxicity"](spark, docs, str(tmp_path))) == whole(docs)
    kept = stage["near_dedup"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == len(rows)
    clean = stage["decontamination"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert whole(clean) == sorted(str(r) for r in docs.collect() if item not in (r.text or ""))
    from legispark.llm import mixing

    planned = {}
    for r in mixing.mix(clean).collect():
        planned[r.doc_id, r.source, r._key] = planned.get((r.doc_id, r.source, r._key), 0) + r.copies
    mixed = stage["mixing"](spark, clean, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.count() == sum(planned.values())
    assert mixed.filter("doc_id = 5").count() == next(n for (i, _, _), n in planned.items() if i == 5)
    out = stage["sharding"](spark, mixed, str(tmp_path))
    assert out.count() == mixed.count() and set(out.columns) == {*docs.columns, "shard", "slot"}


def test_empty_tables(spark, tmp_path):
    docs, _ = made(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0, name
