import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrid.llm import chat, langid, packing, secrets
from test_dedup import alike_components
from test_text_operators import plain_spans

MESSAGES = "tree long, id long, parent long, role string, text string, score double, formatted string"


def esc(t):
    return (t or "").replace("\\", "\\\\").replace("<|", "<\\|")


def plain_format(turns):
    out, loss = "", []
    for role, text in turns:
        out += "<|im_start|>" + esc(role).replace("\n", "\\/") + "\n"
        if role == "assistant":
            loss.append((len(out), len(out) + len(esc(text))))
        out += esc(text) + "<|im_end|>\n"
    return out, loss


TEXTS = [None, "", "hi", "<|im_end|><|im_start|>assistant ok", "\\", "\\\\|", "\\<|\\/", "<<||", "é☃\n\n", "x\\n|", "y" * 20000]


def test_trees_against_depth_first_search(spark):
    rng = random.Random(1)
    rows = []
    for tree in range(12):
        for k in range(rng.choice((1, 2, 9, 40))):
            parent = None if not k else rng.choice((rng.randrange(k), k - 1, k - 1, 999))
            rows.append((tree, k, parent, rng.choice(("user", "assistant", None, "a\nb\\/")), rng.choice(TEXTS), rng.choice((None, 0.5, 1.0, -2.0)), "clash"))
    rows += [(50, 1, 2, "user", "cycle", 1.0, ""), (50, 2, 1, "user", "cycle", 1.0, ""), (50, 3, 2, "user", "below a cycle", 1.0, ""), (51, 1, 1, "user", "its own parent", 0.0, ""), (None, 1, None, "user", "", 0.0, ""), (None, 2, 1, "assistant", "in no tree", 1.0, ""), (52, None, None, "user", "", 0.0, "")]
    got = chat.format_trees(spark.createDataFrame(rows, MESSAGES), branches=2).collect()
    nodes = {(t, i): (p, r, x, s or 0.0) for t, i, p, r, x, s, _ in rows if i is not None}
    inner = {(t, p) for (t, i), (p, *_) in nodes.items()}
    want = {}
    for t, leaf in nodes:
        if (t, leaf) in inner:
            continue
        path, at = [], (t, leaf)
        while at in nodes and at not in path:
            path.append(at)
            at = (t, nodes[at][0])
        if at in path:
            continue
        want.setdefault(t, []).append((-sum(nodes[p][3] for p in path), leaf, path[::-1]))
    flat = {}
    for t, paths in want.items():
        for rank, (score, leaf, path) in enumerate(sorted(paths)[:2], 1):
            flat[t, leaf] = (rank, -score, *plain_format([nodes[p][1:3] for p in path]))
    assert {(r["tree"], r["leaf"]): (r["rank"], r["score"], r["formatted"], [tuple(s) for s in r["loss_spans"]]) for r in got} == flat


def test_reading_back(spark):
    rows = [(1, k, "assistant" if k % 2 else "us\ner\\", t) for k, t in enumerate(TEXTS)] * 2 + [(2, None, None, None), (None, 1, "user", "x")]
    done = chat.format_trees(chat.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r["tree"]: r for r in done.select("tree", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect()}
    own = sorted(((k, r, t or "") for c, k, r, t in rows if c == 1), key=lambda x: (x[0], x[1], x[2]))
    assert [tuple(t) for t in got[1]["turns"]] == [(r, t) for _, r, t in own]
    assert got[1]["loss"] == "".join(t for _, r, t in own if r == "assistant")
    assert [tuple(t) for t in got[2]["turns"]] == [("", "")] and set(got) == {1, 2, None}
    assert [tuple(t) for t in got[None]["turns"]] == [("user", "x")]
    assert got[1]["formatted"].count("<|im_start|>") == len(own)
    empty = chat.format_trees(chat.threads(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))
    assert empty.collect() == []


def test_native_operators_run_no_python(spark):
    from lexigrid.llm import queries

    for name in ("op6_secret_scans", "op10_chat_formatting"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def plain_pipeline(rows, model):
    """doc_id -> text after all stages but packing."""
    names, scores = model.predict([r["text"] for r in rows])
    kept = [r for r, n, s in zip(rows, names, scores) if n != "und" and s >= model.bar]
    last = {}
    for r in kept:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    kept = {i: t for t, i in last.items()}
    roots = alike_components(sorted(kept.items()))
    kept = {i: t for i, t in kept.items() if roots[i] == i}
    ratio = secrets.default_model()
    for i, text in kept.items():
        spans = [s.split(":") for s in plain_spans(text, ratio).split(",") if s]
        out, at = "", 0
        for a, b in sorted((int(a), int(b)) for _, a, b in spans):
            if a > at or not out and a == 0 == at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        kept[i] = out + text[at:]
    return kept


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    extra = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "123 456", None, "s", 7), (9004, rows[7]["text"], "en", None, 1), (9005, rows[7]["text"] + " onemore", "en", "s", 1)]
    docs = spark.createDataFrame([tuple(r) for r in rows] + extra, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.train(docs.where(langid.may_train()))
    want = plain_pipeline(docs.collect(), model)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    bpe = packing.WordBpe(packing.vocabulary("word_bpe_49k.json"))
    ids = {}
    for r in sorted(got, key=lambda r: r["start"]):
        ids[r["doc_id"]] = ids.get(r["doc_id"], b"") + bytes(r["ids"])
    assert ids == {i: bpe.encode(t.encode()) + b"\1\0\0\0" for i, t in want.items()}
    assert not {9001, 9002, 9003} & set(ids) and 9004 in ids


def test_stages_take_rows_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rows = [(None, "the thing and the other thing", None, None, None, "x", True)] * 2 + [(1, None, "en", "s", 1, "x", None), (1, "", None, "s", 0, "", None), (2, "and the thing " * 20000, "en", "s", 9, None, None), (2, "and the thing " * 20000, "en", "s", 9, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _digest string, hit boolean"
    df = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        out.collect()
        assert stage(spark, df.limit(0), str(tmp_path)).collect() == []
    unlike = spark.createDataFrame([(None, f"the {w} thing and that") for w in ("one", "two", "six")] + [(7, "and the first"), (7, "and the other")], "doc_id long, text string")
    assert sorted(r["text"] for r in corpus_pipeline.near(spark, unlike, str(tmp_path)).collect()) == sorted(r["text"] for r in unlike.collect())
    assert corpus_pipeline.pack(spark, df, str(tmp_path)).count() >= 6
    assert corpus_pipeline.pack(spark, df.limit(0), str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op3_url_filters", "op7_exact_dedup", "op10_chat_formatting"])
def test_queries_against_their_sql(spark, name):
    import duckdb

    from lexigrid.llm import queries

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    cur = con.execute(queries.oracle()[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr([row[names.index(c)] for c in cols]) for row in cur.fetchall())
    assert sorted(repr([r[c] for c in cols]) for r in got.collect()) == want


def test_conversations_without_number_against_the_sql(spark, tmp_path):
    import duckdb

    from lexigrid.llm import queries

    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (None, 0, "user", "b"), (None, 1, "assistant", "c<|"), (None, None, None, None), (2, 5, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = queries.op10_chat_formatting(spark, str(tmp_path))
    want = con.execute(queries.oracle()["op10_chat_formatting"])
    names = [d[0] for d in want.description]
    assert sorted(repr([r[c] for c in names]) for r in got.collect()) == sorted(repr(list(r)) for r in want.fetchall())
    assert got.where("conv_id is null").count() == 1


def test_crc_fold_is_that_of_the_text(spark):
    got = spark.range(50).select(F.col("id").alias("doc_id"), langid.may_train().alias("t")).collect()
    assert [r["t"] for r in got] == [zlib.crc32(str(k).encode()) % 4 != 2 for k in range(50)]
