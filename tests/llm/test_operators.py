"""The ten operators against brute force, on awkward documents and on empty tables."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import edge
import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from strataflow.llm import chat_format, license_scan, mixing, ngram_quality, quality_rules, simhash_dedup, toxicity
from strataflow.llm._text import NOT_WORDLIKE, Words
from strataflow.llm.components import connected_components
from strataflow.llm.decontaminate import Matcher, decontaminate
from strataflow.llm.line_dedup import dedup_lines, line_matches
from strataflow.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def bag(rows):
    return Counter(map(str, rows))


# 1


def cut(rows, width):
    own = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in own:
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            first[key] = min(first.get(key, math.inf), math.inf if i is None else i)
    out = []
    for i, w in own:
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < (math.inf if i is None else i):
                gone |= set(range(p, p + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("block", [8 << 20, 700])
def test_substring_dedup(spark, block):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(edge.docs(spark), 50, block_bytes=block).collect()]
    assert bag(got) == bag(cut(edge.texts(), 50))
    assert sum(x[2] for x in got) > 200


CLASHING = "_gone string, _gone_id long, _h long, _kept long, _of long, _copies long, doc_0 string, id long, gone string, h int, row string, kept_id long, copies long, n_chars int, m map<string,int>"


def clashing(spark):
    """The awkward documents with columns named like those that operators make on their way, and a map."""
    more = ("g", 7, 8, 9, 10, 11, "d", 12, "gone", 13, "row", 14, 15, 16, {"a": 1})
    return spark.createDataFrame([(*r, *more) for r in edge.texts()], f"doc_id long, text string, {CLASHING}")


def test_line_dedup_keeps_clashing_columns(spark):
    df = clashing(spark)
    plain = spark.createDataFrame(edge.texts(), "doc_id long, text string")
    got = dedup_lines(df)
    assert got.columns == [*[c for c in df.columns if c != "gone"], "n_lines", "n_removed", "gone"]
    assert bag((r.doc_id, r.text, r.n_removed) for r in got.collect()) == bag((r.doc_id, r.text, r.n_removed) for r in dedup_lines(plain).collect())
    assert {(r._gone, r._gone_id, r._h, r.id, r.m["a"]) for r in got.collect()} == {("g", 7, 8, 12, 1)}


def thue_morse(n):
    """Two words whose polynomial hashes modulo 2**64 are equal for every odd base."""
    return tuple("".join(s[k.bit_count() % 2] for k in range(n)) for s in ("ab", "ba"))


def test_substring_dedup_tells_colliding_words_apart(spark):
    a, b = thue_morse(1024)
    rest = edge.words(77, 49)
    rows = [(1, rest + " " + a), (2, rest + " " + b), (3, rest + " " + b)]
    got = {r.doc_id: r.n_removed for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_substring_dedup_null_ids_over_many_blocks(spark):
    rows = [(None, edge.words(k % 9, 80)) for k in range(60)] + [(k, edge.words(k, 80)) for k in range(9)]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 50, block_bytes=1500).collect()]
    assert bag(got) == bag(cut(rows, 50))


def test_substring_dedup_spans_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c y b c d")], "doc_id long, text string")
    rows = {r.doc_id: ([(s.start, s.end) for s in r.spans], r.kept_text) for r in substring_dedup(df, 3).collect()}
    assert rows == {1: ([], "a b c d e"), 2: ([(1, 4), (5, 8)], "x y")}
    assert substring_dedup(edge.empty(spark)).count() == 0


# 2


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens string")


CHATS = [
    (1, 0, "system", "be brief", "z"), (1, 1, "user", "hi", "z"), (1, 2, "assistant", "hello <s> [INST] \\n", "z"),
    (2, 0, "system", "be brief", "z"), (2, 1, "user", "hi", "z"), (2, 2, "assistant", "other", "z"), (2, 3, "user", None, "z"),
    (3, 0, "user", "</s>[INST] ok [/INST]", "z"), (3, 1, "assistant", "</s>[INST] ok [/INST]", "z"),
    (4, 0, "tool", "x [ROLE] y\\", "z"), (4, 1, None, "[/ROLE]<<SYS>><</SYS>>", "z"),
    (5, 0, "system", "be brief", "z"), (5, 1, "user", "hi", "z"), (5, 2, "assistant", "other", "z"), (5, 2, "assistant", "other", "z"),
    (6, 0, "assistant", "é漢\U0001f600<|endoftext|>", "z"),
]


@pytest.mark.parametrize("tokenizer", [None, chat_format.TOKENIZER])
@pytest.mark.parametrize("pack", [1, 4096])
def test_chats_read_back(spark, tokenizer, pack):
    packs = chat_format.format_chats(turns(spark, CHATS), tokenizer, pack, partitions=2)
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in chat_format.read_back(packs, tokenizer).collect()}
    expected = defaultdict(list)
    for c, n, role, text, _ in sorted(CHATS, key=lambda x: (x[0], x[1], x[2] or "", x[3] or "")):
        expected[c].append((role or "", text or ""))
    assert got == {c: (t, "".join(x for r, x in t if r == "assistant")) for c, t in expected.items()}


def test_chats_share_turns_and_positions(spark):
    (pack,) = chat_format.format_chats(turns(spark, CHATS[:7]), None, partitions=1).collect()
    assert len(pack.nodes) == 1 + 2 + 1 + 2  # the start, the shared turns, and what is not shared
    assert len(pack.tokens) == len(pack.position_ids) == len(pack.loss_mask)
    for node in pack.nodes:
        before = sum(a.end - a.start for a in node.ancestors)
        assert list(pack.position_ids[node.start : node.end]) == list(range(before, before + node.end - node.start))
        if node.parent >= 0:
            parent = pack.nodes[node.parent]
            tokens = lambda ranges: [t for a, b in ranges for t in range(a, b)]
            assert tokens((a.start, a.end) for a in node.ancestors) == tokens([*((a.start, a.end) for a in parent.ancestors), (parent.start, parent.end)])
            assert all(a.end < b.start for a, b in zip(node.ancestors, node.ancestors[1:], strict=False))  # none touch


@pytest.mark.parametrize("turns_each", [400, 800])
def test_ancestors_of_long_chats_grow_with_the_branchings(spark, turns_each):
    rows = [(c, k, "user", f"turn {k}" if c == 1 or k < turns_each // 2 else f"other {k}", "z") for c in (1, 2) for k in range(turns_each)]
    (pack,) = chat_format.format_chats(turns(spark, rows), None, 1 << 20, partitions=1).collect()
    assert max(len(n.ancestors) for n in pack.nodes) == 2
    assert sum(len(n.ancestors) for n in pack.nodes) <= 2 * len(pack.nodes)


def test_chats_escape_round_trip_and_empty(spark):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choices([*chat_format.CONTROL, "\\", "[", "<", "a", " ", "INST]"], k=rng.randint(0, 12)))
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert not any(c in chat_format.escape(text) for c in chat_format.CONTROL)
    assert chat_format.format_chats(turns(spark, [])).count() == 0
    assert chat_format.read_back(chat_format.format_chats(turns(spark, []))).count() == 0


# 3

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, ""), (4, None), (5, "Short ITEM"), (10, "a a a a a a a a a a a"), (6, "three four five six seven eight nine ten eleven twelve zz")]


def scan(rows, items, width):
    windows = defaultdict(set)
    for i, t in items:
        w = TOKEN.findall(lower(t or ""))
        for p in range(max(len(w) - width, 0) + 1) if w else []:
            windows[tuple(w[p : p + width])].add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = TOKEN.findall(lower(t or "")), set(), set()
        for size in {len(k) for k in windows}:
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in windows:
                    hit |= set(range(p, p + size))
                    found |= windows[tuple(w[p : p + size])]
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("shard", [16 << 20, 40])
def test_decontaminate(spark, shard):
    rng = random.Random(5)
    vocabulary = "one two three four five six seven eight nine ten eleven twelve zz a short item".split()
    rows = [*edge.texts(), (50, "x One two, three-four five SIX seven eight nine ten! y"), (51, "a " * 40), (52, "short item. SHORT item"), *[(100 + k, " ".join(rng.choices(vocabulary, k=60))) for k in range(30)], (60, "two three four five six seven eight nine ten eleven twelve zz")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate(df, items, 10, shard_bytes=shard).collect()
    assert bag((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found) == bag(scan(rows, ITEMS, 10))
    clean = {r.doc_id: r.clean_text for r in found}
    assert clean[50] == "x ! y" and clean[5] is None and clean[6] == ""


def test_decontaminate_tells_colliding_words_apart(spark):
    a, b = thue_morse(1024)
    found = decontaminate(spark.createDataFrame([(1, a), (2, b), (3, f"x {b} {b}")], "doc_id long, text string"), spark.createDataFrame([(7, b)], "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_hit, r["items"]) for r in found} == {1: (0, []), 2: (1, ["7"]), 3: (2, ["7"])}


@pytest.mark.parametrize("seed", range(6))
def test_automaton_of_few_words(seed):
    rng = random.Random(seed)
    items = [(k, " ".join(rng.choices("abc", k=rng.randint(0, 14)))) for k in range(12)]
    texts = [(k, " ".join(rng.choices("abcd", k=rng.randint(0, 60)))) for k in range(20)]
    matcher = Matcher([str(i) for i, _ in items], [t for _, t in items], 5)
    words = Words(pa.array([t for _, t in texts]), NOT_WORDLIKE, lower=True)
    hit, found = matcher.find(words)
    got = [(i, int(b - a), int(hit[a:b].sum()), sorted(f)) for (i, _), a, b, f in zip(texts, words.first[:-1], words.first[1:], found, strict=True)]
    assert got == scan(texts, items, 5)


def test_decontaminate_empty_sides(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 for r in decontaminate(edge.docs(spark), none).collect())
    assert decontaminate(edge.empty(spark), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


# 4


def test_kneser_ney_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choices("abcd é", k=rng.randint(0, 60)))) for k in range(40)] + [(40, None), (41, ""), (None, "abc")]
    df = spark.createDataFrame([(i, t, "en", 1.0) for i, t in rows], "doc_id long, text string, lang string, perplexity double")
    trusted = spark.createDataFrame([(k,) for k in range(0, 40, 2)] + [(0,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in ngram_quality.perplexity_filter(df, trusted, order=3, block_bytes=300).collect()}
    taught = {i for i, r in got.items() if r.role == "train"}
    counts = Counter()
    for i, t in rows:
        if i in taught:
            b = b"\0\0" + (t or "").encode()
            counts.update(b[k - 2 : k + 1] for k in range(2, len(b)))
    levels = {3: counts}
    for k in (2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts, contexts = {}, {}
    for k, level in levels.items():
        n = [0] + [sum(v == j for v in level.values()) for j in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        cuts[k] = [min(max(j - (j + 1) * y * (n[j + 1] / n[j]), 0.0), j - 0.01) if n[j] else 0.5 for j in (1, 2, 3)]
        contexts[k] = defaultdict(lambda: [0, 0.0])
        for g, v in level.items():
            contexts[k][g[:-1]][0] += v
            contexts[k][g[:-1]][1] += cuts[k][min(v, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        k, low = len(g), p(g[1:])
        if g[:-1] not in contexts[k]:
            return low
        total, mass = contexts[k][g[:-1]]
        v = levels[k].get(g, 0)
        return ((v - cuts[k][min(v, 3) - 1] if v else 0) + mass * low) / total

    assert sum(p(b"ab" + bytes([c])) for c in range(256)) == pytest.approx(1.0)
    for i, t in rows:
        b = b"\0\0" + (t or "").encode()
        assert got[i].log_prob == pytest.approx(sum(math.log(p(b[k - 2 : k + 1])) for k in range(2, len(b))), rel=1e-4, abs=1e-4)
    assert not got[40].kept and not got[41].kept and got[None].role is None


def test_perplexity_thresholds_are_quantiles_of_the_language(spark):
    rng = random.Random(21)
    rows = [(None if k % 50 == 49 else k, "".join(rng.choices("abcd e", k=rng.randint(0, 90))), (None, "en", "de", "fr")[min(rng.randint(0, 5), 3)]) for k in range(400)] + [(1000, "zz", "it"), (1001, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(k,) for k in range(0, 400, 2)], "doc_id long")
    got = ngram_quality.perplexity_filter(df, trusted, order=2, quantile=0.9, block_bytes=900).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.role == "held out" and r.n_bytes]
    assert {r.doc_id for r in got if r.role} == {k for k in range(0, 400, 2)}

    def cut(own):
        bins = sorted(round(math.log(r.perplexity), 3) for r in own)
        return math.exp(bins[math.ceil(len(bins) * 0.9 - 1e-9) - 1] + 0.0005)

    common = cut(held)
    cuts = {x: cut([r for r in held if r.lang == x]) for x in ("en", "de", "fr")}
    assert len({round(x, 6) for x in cuts.values()}) == 3
    for r in got:
        assert r.threshold == pytest.approx(cuts.get(r.lang, common))
        assert r.perplexity == pytest.approx(math.exp(-r.log_prob / r.n_bytes) if r.n_bytes else 0.0)
        assert r.kept == (r.n_bytes > 0 and r.perplexity <= r.threshold)


def test_perplexity_without_training_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    rows = ngram_quality.perplexity_filter(edge.docs(spark), none).collect()
    assert len(rows) == len(edge.texts())
    assert all(r.kept == bool(r.n_bytes) for r in rows)
    assert ngram_quality.perplexity_filter(edge.empty(spark), none).count() == 0


def test_perplexity_tells_noise(spark):
    rng = random.Random(8)
    clean = [(k, " ".join(rng.choice(["the cat sat", "a dog ran", "on the mat", "and slept"]) for _ in range(30))) for k in range(120)]
    noise = [(1000 + k, "".join(rng.choices("#$%&@!~^", k=200))) for k in range(5)]
    df = spark.createDataFrame([(i, t, "en") for i, t in clean + noise], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in ngram_quality.perplexity_filter(df, spark.createDataFrame([(k,) for k in range(100)], "doc_id long")).collect()}
    # the cut is the quantile of held-out rows alone, so a few clean rows beyond them may lie above it
    assert sum(kept[i] for i, _ in clean) >= 0.95 * len(clean) and not any(kept[i] for i, _ in noise)


# 5


def fingerprint(text):
    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark):
    rows = edge.texts()
    got = simhash_dedup.near_duplicates(edge.docs(spark)).collect()
    fps = [(i, fingerprint(t)) for i, t in rows]
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in got) == Counter(fps)
    distinct = sorted({f for _, f in fps})
    groups = roots([(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4], distinct)
    least = {}
    for i, f in fps:
        if i is not None:
            least[groups[f]] = min(least.get(groups[f], i), i)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((i, least.get(groups[f])) for i, f in fps)
    assert simhash_dedup.near_duplicates(edge.empty(spark)).count() == 0


@pytest.mark.parametrize(("hot", "block"), [(1 << 30, 2048), (3, 7)])
def test_links_connect_all_near_fingerprints(spark, hot, block):
    rng = random.Random(hot % 97)
    centres = [rng.getrandbits(64) for _ in range(40)]
    values = set()
    for c in centres[:10]:
        for _ in range(30):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            values.add(x)
    values |= set(centres)
    signed = [simhash_dedup._signed(x) for x in values]
    links = simhash_dedup.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, hot, block).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 4 for r in links)
    every = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 4]
    assert roots([(r.a, r.b) for r in links], signed) == roots(every, signed)


def test_thresholds_keep_the_pigeonhole(spark):
    sample = np.array([random.Random(1).getrandbits(64) for _ in range(200)], dtype=np.uint64)
    for m in range(2, 6):
        groups = [list(range(64))[k::m] for k in range(m)]
        _, chosen = simhash_dedup.allocate(groups, sample, 10_000, 4)
        assert sum(t + 1 for t in chosen) == 5


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(4).shuffle(order)
    pairs = list(zip(order, order[1:], strict=False)) + [(500, 501), (7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(200), 0), 500: 500, 501: 500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 6


def test_quality_rules(spark):
    got = quality_rules.quality_rules(edge.docs(spark)).collect()
    expected = []
    for i, t in edge.texts():
        t = t or ""
        w = WORD.findall(t)
        places = defaultdict(list)
        for p in range(len(w) - 7):
            places[tuple(w[p : p + 8])].append(p)
        repeat = {q for own in places.values() if len(own) > 1 for p in own for q in range(p, p + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expected.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat), len(w) < 20 or 100 * len(repeat) > 30 * len(w)))
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == bag(expected)
    for r in got:
        assert not (r.base_failed and r.kept)
        if r.n_bytes:
            text = next(t for i, t in edge.texts() if i == r.doc_id)
            assert r.ratio == pytest.approx(len(zstandard.ZstdCompressor(level=3).compress(text.encode())) / len(text.encode()))
    verdicts = {r.doc_id: r.verdict for r in got}
    assert verdicts[13] == verdicts[16] == "repetitive" and verdicts[1] == "ok"
    assert quality_rules.quality_rules(edge.empty(spark)).count() == 0


def judged(text, chunk=4096, tail=256):
    """Ratios and verdict of a text under the production bands, chunk by chunk."""
    raw = text.encode()
    size = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x)) / len(x)
    band = lambda bands, n: next((a, b) for upto, a, b in bands if n <= upto)
    cuts = list(range(0, len(raw), chunk))
    if len(cuts) > 1 and len(raw) - cuts[-1] < tail:
        cuts.pop()
    parts = [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
    ratios = [size(x) for x in parts]
    checks = [(size(raw), *band(quality_rules.DOCUMENT_BANDS, len(raw))), *[(r, *band(quality_rules.CHUNK_BANDS, len(x))) for r, x in zip(ratios, parts, strict=True)]]
    verdict = "repetitive" if any(r < a for r, a, _ in checks) else "incompressible" if any(r > b for r, _, b in checks) else "ok"
    return verdict, min(ratios), max(ratios)


def test_quality_rules_judge_every_byte(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices([chr(c) for c in range(33, 127)], k=n))
    prose = lambda k, n: edge.words(k, n)[:n]
    texts = [prose(1, 4096) + noise(1000), prose(2, 4096) + noise(300), prose(3, 4096) + noise(200), prose(4, 8192) + "ab" * 400, prose(5, 4096) + "x", prose(6, 100), prose(7, 20000), prose(8, 5000), noise(5000), "ab " * 3000, prose(9, 4096)]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality_rules.quality_rules(df).collect():
        verdict, low, high = judged(texts[r.doc_id])
        assert (r.verdict, r.least_chunk_ratio, r.largest_chunk_ratio) == (verdict, pytest.approx(low), pytest.approx(high)), r.doc_id
        assert r.kept == (verdict == "ok" and not r.base_failed)
    assert judged(texts[3])[0] == "repetitive"  # only its tail repeats
    assert judged(texts[0])[0] == "incompressible"  # only its tail is noise


def test_incompressible_text_and_own_bands(spark):
    rng = random.Random(1)
    noise = " ".join("".join(rng.choices([chr(c) for c in range(33, 127)], k=60)) for _ in range(100))
    df = spark.createDataFrame([(1, noise, "xx"), (2, edge.words(2, 2000), "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.verdict for r in quality_rules.quality_rules(df).collect()} == {1: "incompressible", 2: "ok"}
    strict = {"en": (((1 << 62, 0.0, 0.1),), ((1 << 62, 0.0, 9.0),))}
    assert {r.doc_id: r.verdict for r in quality_rules.quality_rules(df, by_lang=strict).collect()}[2] == "incompressible"


# 7


def test_licences(spark):
    rows = [(1, "Released under the MIT License."), (2, "prose\nLicensed under the Foobar License, version 7."), (3, "my driver license expired"), (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License, version 3.\nx"), (7, "Licensed under CC BY-SA 4.0."), (8, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."), (None, "Licensed under CC BY-NC 4.0."), (1, "no licence here"), (9, "x" * 100_000)]
    df = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, family string")
    got = Counter((r.doc_id, r.family, tuple(r.families)) for r in license_scan.scan_licenses(df).collect())
    assert got[(1, "MIT", ("MIT",))] == 2 and got[(2, "unknown", ())] == 1 and got[(6, "GPL-3.0", ("GPL-3.0",))] == 1 and got[(7, "CC-BY-SA-4.0", ("CC-BY-SA-4.0",))] == 1
    assert got[(None, "CC-BY-NC-4.0", ("CC-BY-NC-4.0",))] == 1
    assert all(got[(i, "none", ())] == 1 for i in (3, 4, 5, 9))
    assert next(f for i, _, f in got if i == 8) == ("Apache-2.0", "MIT")
    assert license_scan.scan_licenses(edge.empty(spark)).count() == 0


PROBES = [
    ("Eclipse Public License - v 2.0", "unknown"), ("Released under the Foobar Public License 2.0", "unknown"), ("All rights reserved. No license is granted.", "unknown"),
    ("MIT License", "MIT"), ("License: MIT", "MIT"), ("Released under MIT.", "MIT"), ("Apache License", "Apache-2.0"), ("Distributed under Apache 2.0 terms", "Apache-2.0"), ("GPL v3", "GPL-3.0"), ("Available under MPL 2.0", "MPL-2.0"),
    ("You may obtain a copy of the License at\n    http://www.apache.org/licenses/LICENSE-2.0", "Apache-2.0"),
    ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.", "GPL-3.0"),
    ("// Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated documentation files (the \"Software\"), to deal\n// in the Software without restriction", "MIT"),
    ("ich gehe mit ihm und mit der Software", "none"), ("Mit und.", "none"), ("He drove with a license to the public library", "none"),
]


def judge_notice(notice, model, least=0.5, overlap=0.6):
    """Family, probability, similarity and rival of a notice, by the definition."""
    words = notice.split(" ")
    z = model.bias.astype(float).copy()
    for f in set(words) | {" ".join(words[i : i + 2]) for i in range(len(words) - 1)}:
        if f in model.features:
            z += [round(float(x), 6) for x in model.weights[model.features.index(f)]]
    p = np.exp(z / model.temperature - (z / model.temperature).max())
    p /= p.sum()
    guess = model.classes[int(p.argmax())]
    own = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    weight = {g: x for g, _, _, x, _, _ in model.grams}
    size = sum(weight.get(g, 0.0 if g in license_scan.COMMON else model.strange) for g in own)
    met = defaultdict(lambda: [0.0, 0.0, False])
    for g, family, i, x, total, alone in model.grams:
        if g in own:
            met[family, i][0] += x
            met[family, i][1] = total
            met[family, i][2] |= alone
    like, alone = defaultdict(float), defaultdict(bool)
    for (family, _), (common, total, only) in met.items():
        like[family] = max(like[family], common / max(min(total, size), 1e-9))
        alone[family] |= only
    return guess, p.max(), min(like.get(guess, 0.0), 1.0), alone.get(guess, False)


def test_licence_probes_and_brute_force(spark):
    model = license_scan.train()
    df = spark.createDataFrame([(k, f"{t}\n\nother words here") for k, (t, _) in enumerate(PROBES)], "doc_id long, text string")
    got = {r.doc_id: r.family for r in license_scan.scan_licenses(df).collect()}
    assert [got[k] for k in range(len(PROBES))] == [f for _, f in PROBES]
    rows = license_scan.paragraphs(df).collect()
    assert len(rows) >= 14
    for r in rows:
        guess, p, like, alone = judge_notice(r.notice, model)
        assert r.probability == pytest.approx(p, abs=1e-4) and r.similarity == pytest.approx(like, abs=1e-4)
        assert r.family in (guess, "unknown")
        if r.confirmed:
            assert r.family == guess and p >= 0.5 and like >= 0.6 and alone


def test_licence_candidates(spark):
    df = spark.createDataFrame([(1, "a b x1 x2 c d e f g h x1 i x2\n\nx1 alone. \nx2 too.\nx1 y\nz x2", "c"), (2, None, "c"), (3, "", "c")], "doc_id long, text string, notice string")
    got = [(r.id, r.paragraph, r.place, r.notice) for r in license_scan.candidates(df, ["x1", "x2", *(f"q{k}" for k in range(12))], gap=3, context=1).collect()]
    assert bag(got) == bag([(1, 0, 2, "b x1 x2 c"), (1, 0, 10, "h x1 i x2"), (1, 3, 0, "x1 y z x2")])


def test_licence_training_follows_its_arguments():
    assert license_scan.train() is license_scan.train()
    other = license_scan.train(seed=3, variants=2, rounds=5)
    assert other is not license_scan.train() and not np.array_equal(other.bias, license_scan.train().bias)


def test_licence_templates_are_found(spark):
    own = [(f, t) for f, notices in license_scan.TEMPLATES.items() for t in notices]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(own)], "doc_id long, text string")
    got = {r.doc_id: r.family for r in license_scan.scan_licenses(df).collect()}
    right = sum(got[k] == f for k, (f, _) in enumerate(own))
    assert right >= 0.9 * len(own)


# 8


def lines_removed(rows, run):
    windows, own = {}, []
    for i, t in rows:
        kept = [(k, x.strip(" ")) for k, x in enumerate((t or "").split("\n")) if x.strip(" ")] if t is not None else []
        own.append((i, t, kept))
        for s in range(len(kept) - run + 1):
            key = tuple(x for _, x in kept[s : s + run])
            place = (-math.inf if i is None else i, s)
            windows[key] = min(windows.get(key, place), place)
    gone = defaultdict(set)
    for i, t, kept in own:
        for s in range(len(kept) - run + 1):
            if windows[tuple(x for _, x in kept[s : s + run])] < (-math.inf if i is None else i, s):
                gone[i] |= set(range(s, s + run))
    out = []
    for i, t, kept in own:
        if t is None:
            out.append((i, None, None))
            continue
        flags, cutting = sorted(gone[i]), set()
        for k in flags:
            cutting.add(kept[k][0])
            if k + 1 in gone[i]:
                cutting |= set(range(kept[k][0], kept[k + 1][0]))
        out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cutting), len(cutting)))
    return out


def test_line_dedup(spark):
    rows = edge.texts()
    got = [(r.doc_id, r.text, r.n_removed) for r in dedup_lines(edge.docs(spark), long_words=None).collect()]
    assert bag(got) == bag(lines_removed([x for x in rows if x[0] != 4] + [(4, rows[3][1])] * 2, 3))
    with_long = {r.doc_id: r.text for r in dedup_lines(edge.docs(spark)).collect()}
    assert with_long[3] == rows[2][1] and with_long[4] == "" and with_long[2] == rows[1][1]  # one line of 60 words
    assert {i: n for i, _, n in got}[10] == 6 and {i: n for i, _, n in got}[15] == 4
    assert dedup_lines(edge.docs(spark)).columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert dedup_lines(edge.empty(spark)).count() == 0


@pytest.mark.parametrize(("gram", "window"), [(2, 2), (1, 2), (2, 3), (3, 1)])
def test_line_dedup_of_random_lines(spark, gram, window):
    rng = random.Random(gram * 10 + window)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", " a ", "", "d e"]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    got = [(r.doc_id, r.text, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), gram, window, long_words=None).collect()]
    assert bag(got) == bag(lines_removed(rows, gram + window - 1))


def test_line_matches_extend_both_ways(spark):
    a, b = [f"alpha {k}" for k in range(6)], [f"beta {k}" for k in range(4)]
    rows = [(1, "\n".join(["x", *a, "y"])), (2, "\n".join(b)), (3, "\n".join(["p", *a, *b, "q"])), (None, "\n".join(a))]
    got = [(r.id, r.first, r.last, r.source_id, r.source_s) for r in line_matches(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()]
    assert bag(got) == bag([(3, 1, 6, 1, 1), (3, 7, 10, 2, 0)])  # neighbours with different origins are two matches
    # a null id comes first and loses nothing
    got = {(r.doc_id, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 6), (2, 0), (3, 10), (None, 0)}


def test_line_dedup_runs_no_python(spark):
    plan = dedup_lines(edge.docs(spark))._jdf.queryExecution().executedPlan().toString() + license_scan.scan_licenses(edge.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 9


def test_mixing(spark):
    rows = [(r[0], r[1], r[3]) for r in edge.rows()] + [(1000 + k, edge.words(k, 1 + k % 40), "abc"[k % 3] if k % 11 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while True:  # reshare the excess until no target is above its cap
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= set(over)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.mix_sources(df.repartition(3), ranges=3).collect()
    assert bag(got) == bag(again)
    assert mixing.mix_sources(edge.empty(spark)).count() == 0


def test_mixed_documents_are_those_of_the_mix(spark):
    rows = [(None if k % 9 == 0 else k, edge.words(k, 1 + k % 40), "abcdefg"[k % 7] if k % 11 else None, "x") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    sizes = {(r.doc_id, r.size, r.source): r.copies for r in mixing.mix_sources(df).collect()}
    got = Counter((r.doc_id, len(WORD.findall(r.text)), r.source, r.copies) for r in mixing.mix_documents(df).collect())
    assert set(got) == {(*k, v) for k, v in sizes.items() if v}
    assert mixing.mix_documents(edge.empty(spark)).count() == 0


def test_source_targets_over_many_ranges(spark, monkeypatch):
    sizes = [(f"s{k:03}" if k else None, 1 + k * k % 97) for k in range(150)]
    df = spark.createDataFrame(sizes, "source string, size long")
    whole = {r.source: (r["rank"], r.target) for r in mixing.source_targets(df).collect()}
    monkeypatch.setattr(mixing.running, "__defaults__", ((), 20))
    parts = {r.source: (r["rank"], r.target) for r in mixing.source_targets(df).collect()}
    assert whole == parts and sorted(r for r, _ in whole.values()) == list(range(1, 151)) and whole[None][0] == 150


def test_mixing_prefers_quality(spark):
    rows = [(k, "#" * 50 + " " + edge.words(k, 20) if k % 2 else edge.words(k, 21), "ab"[k % 4 // 2]) for k in range(2000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 9)).collect()
    low = [r for r in got if r.source == "a"]
    share = lambda odd: np.mean([r.copies for r in low if r.doc_id % 2 == odd])
    assert share(0) > share(1)


# 10


def test_toxicity_folds_and_excepts(spark):
    lexicon = toxicity.Lexicon({"idiot": 4.0, "trash": 4.0, "bad$": 1.0}, ["trash can"])
    hits = lambda t: len(lexicon.hits(toxicity.fold(t)))
    assert hits("You IDIOT") == hits("1d10t") == hits("idіоt") == hits("ｉｄｉｏｔ") == hits("id​iot") == 1
    assert hits("idiots!") == 1 and hits("xidiot") == 0
    assert hits("a trash can and trash") == 1 and hits("bad") == 1 and hits("badge") == 0


def test_toxicity_learns(spark):
    rng = random.Random(1)
    make = lambda k: edge.words(k, rng.randint(10, 80))
    rows = [(k, make(k), 0) for k in range(600)] + [(600 + k, make(600 + k) + " zorgish " + make(k) + " you Z0RG", 1) for k in range(120)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (None, 1), (9999, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(df, toxicity.training_rows(labels))
    assert any(e.startswith("zorg") for e in lexicon.weights)
    got = {r.doc_id: r for r in toxicity.toxicity(df, lexicon).collect()}
    assert sum(got[i].predicted == y for i, _, y in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_edges(spark):
    lexicon = toxicity.learn(edge.docs(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert lexicon.weights == dict(toxicity.SEED)
    got = toxicity.toxicity(edge.docs(spark), lexicon).collect()
    assert len(got) == len(edge.texts()) and all(r.predicted == 0 for r in got)
    assert toxicity.toxicity(edge.empty(spark), lexicon).count() == 0


def test_toxicity_of_many_exceptions_is_linear():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "trash": 4.0}, ["trash can", "trash can lid", "an idiot trash can"])
    began = time.perf_counter()
    assert len(lexicon.hits(toxicity.fold("idiot trash can " * 60_000))) == 60_000
    assert time.perf_counter() - began < 20  # comparing all hits with all phrases takes minutes
    assert [x[0] for x in lexicon.hits("an idiot trash can and trash")] == [23]


def naive_hits(lexicon, text):
    """Weights that count, by looking at every place for every entry and phrase."""
    t = toxicity.fold(text)
    ends = lambda e: e == len(t) or not t[e].isalnum()
    begins = [k for k in range(len(t)) if not k or not t[k - 1].isalnum()]
    spared = [(k, k + len(p)) for p in map(toxicity.fold, lexicon.exceptions) for k in begins if t.startswith(p, k) and ends(k + len(p))]
    found = {}
    for k in begins:
        for entry in lexicon.weights:
            word = entry.rstrip("$")
            if t.startswith(word, k) and (not entry.endswith("$") or ends(k + len(word))) and not any(a <= k and k + len(word) <= b for a, b in spared):
                found.setdefault((k, len(word)), 0.0)
                found[k, len(word)] += lexicon.weights[entry]
    longest = {}
    for (k, n), w in sorted(found.items()):
        longest[k] = w
    return sorted(longest.values())


def test_toxicity_against_brute_force(spark):
    rng = random.Random(12)
    lexicon = toxicity.Lexicon({"ab": 1.0, "abc": 2.0, "abc$": 0.5, "ba$": 3.0, "cab": 1.5, "a$": 0.25}, ["ab ba", "cab c"], (-2.0, 1.0, 3.0, -0.1))
    rows = [(k, "".join(rng.choices(["a", "b", "c", " ", "ab", "cab", "B", "4", "8", ".", "а", "\u200b"], k=rng.randint(0, 60)))) for k in range(200)]
    for r in toxicity.toxicity(spark.createDataFrame([*rows, (None, None)], "doc_id long, text string"), lexicon).collect():
        text = dict(rows).get(r.doc_id, "")
        weights, words = naive_hits(lexicon, text), len(toxicity.fold(text).split())
        z = -2.0 + math.log1p(sum(weights)) + 3.0 * sum(weights) / max(words, 1) - 0.1 * math.log1p(words)
        assert r.hits == len(weights) and r.score == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_learns_long_words_and_many(spark):
    # more entries than any fixed list would have, one of them longer than 24 letters
    long = "zorg" + "xyz" * 10
    bad = [f"{a}{b}qqv" for a in "bcdfghjklmnpqrstvwxz" for b in "bcdfghjklmnpqrstvwxz"][:300] + [long]
    rows = [(k, edge.words(k, 30), 0) for k in range(700)] + [(700 + k, " ".join(bad[k % len(bad) :: 7]) + " " + edge.words(900 + k, 10), 1) for k in range(350)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    lexicon = toxicity.learn(df, spark.createDataFrame([(i, y, "x") for i, _, y in rows], "doc_id long, toxic int, text string"))
    assert len(lexicon.weights) > 200 and any(e.startswith("zorgxyz") for e in lexicon.weights)


# later rounds


def passages_removed(rows, run, long_words):
    """Later copies of runs of `run` lines, and of shorter runs of `long_words` words; what touches is one passage."""
    own = [(i, t, [(k, x.strip(" ")) for k, x in enumerate(t.split("\n")) if x.strip(" ")]) for i, t in rows]
    units = [(i, s, tuple(x for _, x in kept[s : s + w])) for i, _, kept in own for w in range(1, run + 1) for s in range(len(kept) - w + 1)]
    units = [u for u in units if len(u[2]) == run or sum(len(WORD.findall(x)) for x in u[2]) >= long_words]
    first = {}
    for i, s, key in units:
        first[key] = min(first.get(key, (i, s)), (i, s))
    gone = defaultdict(set)
    for i, s, key in units:
        if first[key] < (i, s):
            gone[i] |= set(range(s, s + len(key)))
    out = []
    for i, t, kept in own:
        cutting = {kept[k][0] for k in gone[i]} | {j for k in gone[i] if k + 1 in gone[i] for j in range(kept[k][0], kept[k + 1][0])}
        out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cutting), len(cutting)))
    return out


@pytest.mark.parametrize(("gram", "window"), [(2, 2), (1, 2), (3, 1)])
def test_line_dedup_of_long_short_passages(spark, gram, window):
    rng = random.Random(gram * 10 + window)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", " a ", "", "d e", "f g h i", "j k l m n o", "p q r s t u v"]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    got = [(r.doc_id, r.text, r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), gram, window, long_words=6).collect()]
    assert bag(got) == bag(passages_removed(rows, gram + window - 1, 6))


def test_toxicity_learns_from_all_different_texts(spark):
    # the least hash of the long words is that of one word that all texts share
    common = min((w for k in range(400) for w in [f"common{chr(97 + k % 26)}{chr(97 + k // 26)}xx"]), key=lambda w: xxhash.xxh64_intdigest(w))
    rows = [(k, f"{common} {edge.words(k, 20)}", 0) for k in range(200)] + [(200 + k, f"{common} zorgish {edge.words(200 + k, 20)}", 1) for k in range(40)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    lexicon = toxicity.learn(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert any(e.startswith("zorg") for e in lexicon.weights)


NAMED = [("MPL-2.0", "MPL-2.0"), ("GPL-2.0", "GPL-2.0"), ("LGPL-2.1", "LGPL"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC BY 4.0", "CC-BY-4.0"), ("GPLv3", "GPL-3.0"), ("AGPLv3", "AGPL-3.0"), ("The Unlicense", "Unlicense"), ("WTFPL", "unknown"), ("license: GPL-2.0-only", "GPL-2.0")]
DENIED = ["We do not use the Apache License 2.0 here", "the mit license is not what we use, we are proprietary", "no longer under the GPL v3", "This is never licensed under the MIT License"]
CUT = "Permission is hereby granted, free of charge, to any person{}obtaining a copy of this software and associated documentation files"


def test_licences_by_name_denied_and_cut_short(spark):
    rows = [t for t, _ in NAMED] + DENIED + ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND', CUT.format(" "), CUT.format("\n")]
    got = {r.doc_id: (r.family, r.confirmed) for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(f"{t}\n\nother words" for t in rows)), "doc_id long, text string")).collect()}
    assert [got[k][0] for k in range(len(NAMED))] == [f for _, f in NAMED]
    assert not any(got[len(NAMED) + k][1] for k in range(len(DENIED) + 1))  # nor is a disclaimer that many licences have
    assert [got[len(rows) - k] for k in (2, 1)] == [("MIT", True)] * 2
