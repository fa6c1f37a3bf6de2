"""The pipeline's stages on awkward documents, and the operators' queries against their SQL."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import edge
import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F
from test_operators import TOKEN, WORD, clashing, fingerprint, lower, roots, scan

from strataflow.llm import queries
from strataflow.llm._shared import materialize
from strataflow.llm.toxicity import learn, training_rows

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLE_SQL:
        assert_same(df, con, queries.ORACLE_SQL[name])
    else:
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("make", [edge.docs, edge.empty])
def test_stages(spark, make):
    docs = materialize(make(spark), "edge")
    for name, stage in pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), name)
        n, before = out.count(), docs.count()
        assert n <= before
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        if make is edge.empty:
            assert n == 0
        docs = out
    if make is edge.docs:
        assert docs.count() >= 5


def test_stages_keep_clashing_columns(spark):
    docs = clashing(spark).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    own = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    for name, stage in pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), f"clash-{name}")
        last = name == pipeline.STAGES[-1][0]
        assert sorted(out.columns) == sorted(docs.columns)
        assert out.count() >= 5
        told = {tuple(str(r[c]) for c in own if not (last and c == "copies")) for r in out.collect()}
        assert told == {tuple(str(r[c]) for c in own if not (last and c == "copies")) for r in docs.collect()}, name
        docs = out


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == [*COLUMNS, "copies"]
    assert 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.where("copies < 1 OR copies > 3").count() == 0


def test_near_copies_leave_one(spark):
    rows = [(1, edge.words(1, 200)), (2, edge.words(1, 200)), (2, edge.words(1, 200)), (3, edge.words(2, 200)), (None, edge.words(3, 200))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in pipeline.keep_one_of_near_copies(spark, docs, SF).collect()) == ["1", "3", "None"]


def test_line_dedup_takes_long_passages_of_one_and_two_lines(spark):
    one, two = edge.words(1, 60), edge.words(2, 30) + "\n" + edge.words(3, 30)
    rows = [(1, one), (2, one), (3, two), (4, two), (5, "short line"), (6, "short line"), (7, "begin\n" + one + "\nend")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert got == {1: one, 2: "", 3: two, 4: "", 5: "short line", 6: "short line", 7: "begin\nend"}


def test_near_copies_of_different_components_stay(spark):
    rows = [(None, edge.words(1, 200)), (None, edge.words(2, 200)), (None, edge.words(3, 200)), (7, edge.words(4, 200)), (7, edge.words(5, 200)), (7, edge.words(5, 200)), (8, edge.words(4, 200)), (None, edge.words(5, 200))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.keep_one_of_near_copies(spark, docs, SF)
    assert got.columns == COLUMNS
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("None", edge.words(k, 200)) for k in (1, 2, 3)] + [("7", edge.words(4, 200)), ("7", edge.words(5, 200))])


# run() against brute force: rows are (id, text, source)

NULL_FIRST = -math.inf


def without_repeated_lines(rows):
    own = [(i, t, [(k, x.strip(" ")) for k, x in enumerate(t.split("\n")) if x.strip(" ")] if t is not None else []) for i, t, _ in rows]
    units = [(NULL_FIRST if i is None else i, s, tuple(x for _, x in kept[s : s + w])) for i, _, kept in own for w in (1, 2, 3) for s in range(len(kept) - w + 1)]
    units = [u for u in units if len(u[2]) == 3 or sum(len(WORD.findall(x)) for x in u[2]) >= pipeline.LONG_WORDS]
    first = {}
    for i, s, key in units:
        first[key] = min(first.get(key, (i, s)), (i, s))
    gone = defaultdict(set)
    for i, s, key in units:
        if first[key] < (i, s) and i != NULL_FIRST:
            gone[i] |= set(range(s, s + len(key)))
    out = []
    for (i, t, kept), (_, _, source) in zip(own, rows, strict=True):
        if t is None:
            out.append((i, t, source))
            continue
        places = {k for k in gone[i] if k < len(kept)}
        cutting = {kept[k][0] for k in places} | {j for k in places if k + 1 in places for j in range(kept[k][0], kept[k + 1][0])}
        out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cutting), source))
    return out


def one_of_near_copies(rows):
    fps = [fingerprint(t) for _, t, _ in rows]
    distinct = sorted(set(fps))
    group = roots([(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4], distinct)
    kept = defaultdict(set)
    for (i, t, s), fp in zip(rows, fps, strict=True):
        kept[group[fp]].add((i is None, i or 0, t, s))
    # the least id stays; of texts with that id, or without any, one
    return {g: {x for x in own if x[:2] == min(own)[:2]} for g, own in kept.items()}


def clean_of(rows, items):
    out = []
    for (i, t, s), (_, n, hit, _) in zip(rows, scan([(i, t) for i, t, _ in rows], items, 10), strict=True):
        if hit > n * pipeline.MOST_COVERED:
            continue
        if hit:
            spans, w, cover = [m.span() for m in TOKEN.finditer(lower(t))], TOKEN.findall(lower(t)), set()
            for _, item in items:
                iw = TOKEN.findall(lower(item or ""))
                k = min(10, len(iw))
                for p in range(len(iw) - k + 1) if k else []:
                    cover |= {q for a in range(len(w) - k + 1) if w[a : a + k] == iw[p : p + k] for q in range(a, a + k)}
            text, at, q = "", 0, 0
            while q < len(w):
                if q in cover:
                    text += t[at : spans[q][0]]
                    while q in cover:
                        at, q = spans[q][1], q + 1
                else:
                    q += 1
            t = text + t[at:]
        out.append((i, t, s))
    return out


def mixed(rows):
    size = lambda t: len(WORD.findall(t or ""))
    totals = defaultdict(int)
    for _, t, s in rows:
        totals[s] += size(t)
    names = sorted([s for s in totals if s is not None], key=str.encode) + ([None] if None in totals else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = sum(totals.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * totals[s]]
        if not over:
            target |= share
            break
        target |= {s: 3.0 * totals[s] for s in over}
        open_ -= set(over)
    out = []
    for s in names:
        epochs = min(3, int(target[s] // totals[s])) if totals[s] else 0
        own = []
        for i, t, of in rows:
            if of == s and i is not None:
                u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 1) / float((1 << 52) + 1)
                n, signs = size(t), sum(c in "#*$%&|<>" for c in t or "")
                own.append((-math.log(u) / ((n + 1) / (n + signs + 1.0)), i, n, t))
        before = 0
        for _, i, n, t in sorted(own):
            extra = n > 0 and epochs < 3 and 2 * before + n <= 2 * (target[s] - epochs * totals[s])
            before += n
            if epochs + extra:
                out.append((i, t, s, epochs + extra))
    return out


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(17)
    passage, line = "\n".join(edge.words(900 + k, 6) for k in range(4)), edge.words(950, 55)
    items = [(k, edge.words(970 + k, 25)) for k in range(4)] + [(9, None)]
    rows = []
    for k in range(160):
        t = edge.words(k, rng.randint(5, 120))
        t = t + "\n" + passage if k % 9 == 0 else t + "\n" + line + "\nlast " + edge.words(k + 500, 8) if k % 11 == 0 else t
        t = t + " " + items[k % 4][1] + " " + edge.words(k + 300, 12) if k % 7 == 0 else t
        t = t + " zorgish you zorgish" if k % 5 == 0 else t
        rows.append((k, t, None if k % 13 == 0 else "abc"[k % 3]))
    rows += [(200 + k, rows[2 * k + 1][1], "a") for k in range(20)]  # exact copies
    rows += [(230 + k, rows[2 * k + 1][1] + " end", "b") for k in range(20)]  # near copies, some of them
    rows += [(300, items[0][1], "a"), (301, "", "a"), (302, None, "b"), (303, " \n", None), (7, edge.words(777, 40), "c"), (7, edge.words(778, 40), "c")]
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, int("zorgish" in (t or ""))) for i, t, _ in rows if i < 160], "doc_id long, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    lexicon = learn(docs, training_rows(labels))
    left = [r for r in rows if lexicon.score(r[1]) < 0.7]
    assert 100 < len(left) < len(rows)
    left = without_repeated_lines(left)
    groups = one_of_near_copies(left)
    left = sorted(((i, t, s) for own in groups.values() for _, i, t, s in own), key=str)
    left = clean_of(left, items)
    expected = mixed(left)
    got = [(r.doc_id, r.text, r.source, r.copies) for r in pipeline.run(spark, folder).collect()]
    assert Counter(got) == Counter(expected)
    assert len({i for i, _, _, _ in got}) > 60
    # reruns agree
    assert Counter(got) == Counter((r.doc_id, r.text, r.source, r.copies) for r in pipeline.run(spark, folder).collect())


def test_run_keeps_unlike_texts_without_ids(spark):
    rows = [(None, edge.words(k % 30, 40 + k % 30), "s") for k in range(90)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.keep_one_of_near_copies(spark, docs, SF).collect()
    assert Counter(r.text for r in got) == Counter(t for _, t, _ in rows[:30])
