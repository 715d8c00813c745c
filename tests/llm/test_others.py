"""Chats, archives, vectors, the registered queries against their SQL, and the pipeline."""

import collections
import gzip
import io

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import DATA, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from pathloom.llm import ann, chat, lines, mixing, neardup, packing, quality, registry, warc
from pathloom.llm.common import scratch, stored

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, DATA).toPandas()) == rows_of(duck.execute(SQL[name]).df())


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline")
    assert numbers == list(range(1, 11)) and "pipeline" in QUERIES and set(SQL) <= set(QUERIES)


# Chats
@given(st.text(alphabet="<>/s[]INST\\ROLEx \n", max_size=40))
@settings(max_examples=500, deadline=None)
def test_escaping_is_reversible(text):
    quoted = chat.escape(text)
    assert chat.unescape(quoted) == text and not any(c in quoted for c in chat.CONTROLS)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[ROLE]", "</s>"]), st.text(alphabet="</s>[INST] \\ab\n", max_size=30)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_chats_round_trip(turns):
    text, spans = chat.compile_template(chat.TEMPLATE)(messages=[{"role": r, "text": t} for r, t in turns])
    assert chat.turns_of(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_template_language():
    run = lambda source, **names: chat.compile_template(source)(**names)[0]
    assert run("{% for x in xs %}{{ loop.index }}{{ x | upper }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=["a", "b"]) == "1A, 2B"
    assert run("{% set y = 'q' if n > 2 else 'z' %}{{ y }}", n=3) == "q"
    assert run("a {%- if x in 'abc' -%} b {%- elif x == none -%} n {%- else -%} c {%- endif %}", x="b") == "ab"
    assert run("{{ m['k'].z | trim ~ '!' }}{# no #}", m={"k": {"z": " v "}}) == "v!"
    assert run("{{ m.missing.more }}", m={}) == ""
    assert chat.parse("{{ 'a' ~ 1 }}{% if 1 == 2 %}x{% endif %}{% if true %}b{% endif %}") == [("text", "a1b")]
    assert chat.compile_template("x{% generation %}yz{% endgeneration %}")() == ("xyz", [(1, 3)])


@pytest.mark.parametrize("source", ["{{ x.__class__() }}", "{{ f(1) }}", "{% import os %}", "{{ x | unknown }}", "{% for x in y %}", "{{ }}", "{{ 'a }}", "{% if %}{% endif %}"])
def test_templates_stay_in_their_sandbox(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)
    assert chat.compile_template("{{ x.__class__ }}")(x="a")[0] == ""


def test_op1_odd(spark):
    rows = [(1, 1, None, "b"), (1, 0, "user", None), (None, 0, "user", "x"), (1, 1, None, "b"), (2, None, "assistant", "é" * 100_000), (3, 0, "tool", "<s>\\[INST]")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1].n_turns == 3 and got[None].n_turns == 1 and got[2].loss_chars == 100_000 and got[3].loss_chars == 0
    formatted = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}
    assert chat.turns_of(formatted[1]) == [("user", ""), ("", "b"), ("", "b")] and chat.turns_of(formatted[3]) == [("tool", "<s>\\[INST]")]
    assert chat.format_conversations(df.where("false")).count() == 0


# Archives
def test_op5_odd(spark):
    rows = [(5, "u", "same"), (3, None, "same"), (3, None, "same"), (None, "n", "same"), (9, "a\r\nb: c", None), (8, "", ""), (7, "x", "é" * 200_000), (6, "k", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n long")
    index = warc.write_archives(pages, scratch(spark, "w"))
    got = collections.defaultdict(list)
    for r in warc.read_records(index, payloads=True).collect():
        got[r.page_id].append(r)
    assert sorted(r.record_type for r in got[3]) == ["response", "revisit"] and got[5][0].refers_to == 3 and got[None][0].refers_to == 3
    assert got[5][0].payload is None and got[5][0].payload_bytes == 4 and {r.payload for r in got[3]} == {b"same", None} and {r.refers_to for r in got[3]} == {3, None}
    assert got[8][0].record_type == "response" and got[9][0].refers_to == 8 and got[7][0].payload_bytes == 400_000
    assert got[6][0].payload == b"\r\n\r\nWARC/1.1\r\n"
    few = warc.read_records(index.where("page_id in (5, 7)"), gap=0, most=1)
    assert {r.page_id for r in few.collect()} == {5, 7}
    large = warc.write_archives(pages, scratch(spark, "w"), min_revisit=5)
    assert {r.type for r in large.where("page_id = 5").collect()} == {"response"}
    assert warc.write_archives(pages.where("false"), scratch(spark, "w")).count() == 0


def test_op5_deals_a_common_payload(spark):
    """Payloads are joined by page: one that most pages share doesn't meet in a task."""
    pages = spark.createDataFrame([(i, "u", "common" if i % 3 else f"own {i}") for i in range(3000)], "page_id long, url string, html string")
    index = warc.write_archives(pages, scratch(spark, "w"))
    rows = warc.read_records(index).collect()
    assert len(rows) == 3000 and sum(r.record_type == "revisit" for r in rows) == 1999 and {r.refers_to for r in rows} == {None, 1}
    files = [r["count"] for r in index.groupBy("file").count().collect()]
    assert len(files) > 1 and max(files) < 1500


def test_records_are_gzip_members():
    one, two = warc.record(1, "u", b"abc", warc.sha1_base32(b"abc"), None), warc.record(2, "v", b"abc", warc.sha1_base32(b"abc"), warc.page_urn(1))
    whole = gzip.GzipFile(fileobj=io.BytesIO(one + two)).read()
    assert whole.count(b"WARC/1.1\r\n") == 2
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", warc.sha1_base32(b"abd"), None))


def test_ranges_are_coalesced():
    places = [("a", 0, 10), ("a", 10, 5), ("a", 20, 5), ("a", 1000, 5), ("b", 0, 1)]
    assert [(f, a, b, len(m)) for f, a, b, m in warc.ranges(places, 5, 100)] == [("a", 0, 25, 3), ("a", 1000, 1005, 1), ("b", 0, 1, 1)]
    assert [b - a for _, a, b, _ in warc.ranges(places, 5, 15)] == [15, 5, 5, 1]


# Vectors
def _brute(rows, asked, k):
    out = []
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, v in good:
        if q in asked:
            found = sorted({(float(ann.distances(v[None], w[None])[0, 0]), i) for i, w in good if i != q and len(w) == len(v)})[:k]
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(found)]
    return sorted(set(out))


def test_op4_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(500)] + [(600 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]
    rows += [(700, None), (701, []), (702, [0.0] * 4), (703, [1.0, None, 2.0, 3.0]), (704, [float("nan"), 1.0, 1.0, 1.0]), (705, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (800, [1.0, 2.0]), (801, [2.0, 2.0]), (600, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, shard string")
    asked = {i for i, _ in rows if i is not None and i % 100 == 0}
    found = sorted(map(tuple, ann.nearest(df, df.where("vec_id % 100 = 0"), k=7, leaf=8, shard=20, block=3).collect()))
    assert found == _brute(rows, asked, 7)
    two = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<float>")
    assert sorted((r.rank, r.vec_id, r.score) for r in ann.nearest(two, two.where("vec_id = 0"), k=1).collect()) == [(1, 1, 1.0), (1, 2, 2.0)]
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_op4_factor_trades_recall():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 3
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))
    ids = [np.array([i]) for i in range(len(x))]
    tree, q, qids = ann.Tree(x, 64), x[::50], np.arange(0, len(x), 50)
    searches = {f: ann.Search(tree, ids, q, qids, 10, f) for f in (1.0, 1.6)}
    for s in searches.values():
        s.run()
    exact = searches[1.0].near
    d = ann.distances(q, x)
    d[np.arange(len(q)), qids] = np.inf
    assert (np.sort(d, axis=1)[:, :10] == searches[1.0].best).all()
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, searches[1.6].near)])
    assert recall >= 0.9 and searches[1.6].seen < searches[1.0].seen < d.size


# Pipeline
def test_pipeline_of_odd_and_no_documents(spark, odd_docs, no_docs):
    """Nulls, empty and very long texts, repeated rows and clashing names run through all stages; no stage adds or loses a column."""
    extra = odd_docs.withColumns({n: F.lit(1) for n in ("_gone", "_doc", "_times", "_bad_host", "_source", "_nth")})
    for docs in (extra, no_docs):
        now = docs
        for _, f in corpus_pipeline.STAGES[:-1]:
            now = stored(f(spark, now, DATA), "t")
            assert now.columns == docs.columns
        packed = stored(corpus_pipeline.STAGES[-1][1](spark, now, DATA), "t")
        assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in now.collect()}


def test_pipeline_stages(spark):
    """Each stage's rows are those its operator's own verdicts give, on its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "mixing", "packing"]
    outs, now = [], docs
    for _, f in corpus_pipeline.STAGES:
        outs.append(stored(f(spark, now, DATA), "t"))
        now = outs[-1]
    rules, deduped, distinct, mixture, packed = outs
    assert all(o.columns == docs.columns for o in outs[:-1])
    ids = lambda df: collections.Counter(r.doc_id for r in df.collect())
    assert ids(rules) == ids(quality.judge(docs).where("kept"))
    left = lines.deduplicated(rules).where("_n_dropped = 0 or text rlike '[^ \\\\t-\\\\r]'")
    assert {(r.doc_id, r.text) for r in deduped.collect()} == {(r.doc_id, r.text) for r in left.collect()}
    assert all(r.n_chars == len(r.text) for r in deduped.collect() if r.doc_id % 7 == 0)
    assert ids(distinct) == ids(neardup.near_duplicates(deduped).where("kept"))
    taken = {r.doc_id: r.copies for r in mixing.mix(distinct).collect() if r.copies}
    assert ids(mixture) == taken
    tokens = packed.groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in tokens} == set(taken) and packed.count() == packing.pack(mixture).count()


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0 and corpus_pipeline.ORACLE_SQL is None
