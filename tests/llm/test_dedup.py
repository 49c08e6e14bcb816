import random

import numpy as np
import pytest

from lexigrid.llm import exact_dedup, simhash, wide_simhash

SCHEMA = "doc_id long, text string, digest string, hit boolean, fp long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


ROWS = [(5, "a"), (3, "a"), (9, None), (2, ""), (7, "b" * 5000), (8, "b" * 5000), (4, "ab"), (4, "ab"), (None, "c"), (1, "c"), (11, "a "), (6, "ü")]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("digest_bytes", [32, 1])
@pytest.mark.parametrize("memtable_rows", [2, 1000])
def test_labels_against_brute_force(spark, keep, digest_bytes, memtable_rows):
    rows = ROWS + [(100 + i, f"t{i % 40}") for i in range(90)]
    got = exact_dedup.duplicate_labels(docs(spark, rows), keep=keep, digest_bytes=digest_bytes, memtable_rows=memtable_rows).collect()
    low = -(1 << 63)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(low if i is None else i)
    pick = max if keep == "largest" else min
    want = sorted((low if i is None else i, pick(groups[t or ""]), len(groups[t or ""])) for i, t in rows)
    assert sorted((low if r["doc_id"] is None else r["doc_id"], low if r["keep_id"] is None else r["keep_id"], r["group_size"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_dropping_keeps_one_row_of_each_text_with_all_columns(spark, digest_bytes):
    df = docs(spark, ROWS)
    got = exact_dedup.drop_exact_duplicates(df, keep="largest", digest_bytes=digest_bytes)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == sorted([(5, "a"), (9, ""), (8, "b" * 5000), (4, "ab"), (1, "c"), (11, "a "), (6, "ü")])


def test_filter_grows_with_what_it_holds(spark):
    from lexigrid.llm import common

    assert [common.filter_bits(n) for n in (0, 4096, 4097, 10**7, 10**12)] == [1 << 16, 1 << 16, 1 << 17, 1 << 28, 1 << 28]
    rng = np.random.default_rng(21)
    inside, outside = [rng.bytes(32) for _ in range(6000)], [rng.bytes(32) for _ in range(6000)]
    found = common.DigestFilter.build(spark.createDataFrame([(d,) for d in inside] + [(None,)], "digest binary"), "digest")
    assert found.hits(inside).all() and found.hits(outside).mean() < 0.02
    assert not common.DigestFilter.build(spark.createDataFrame([], "digest binary"), "digest").hits(outside).any()


def test_empty_table(spark):
    assert exact_dedup.duplicate_labels(docs(spark, [])).collect() == []
    assert exact_dedup.drop_exact_duplicates(docs(spark, [])).collect() == []
    assert simhash.near_duplicates(docs(spark, [])).collect() == []
    assert simhash.drop_near_duplicates(docs(spark, [])).collect() == []


def plain_simhash(text, shingle=4):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", None, " \n", "One", "a b c", "a b c d", "A b C d e", "É a\tb c  d\x0be f g é", "x " * 70000])
def test_fingerprint(text):
    assert simhash.simhash(None if text is None else text.encode()) == (plain_simhash(text) if text is None or len(text) < 1000 else simhash.simhash(b"x x x x"))


def test_golay_words_within_two_bits_share_an_index():
    rng = np.random.default_rng(3)
    assert (simhash.golay_index() != 0xFFFF).all()
    for bits in (21, 22, 23):
        a = rng.integers(0, 1 << bits, 3000, dtype=np.uint32)
        b = a ^ (np.uint32(1) << rng.integers(0, bits, 3000, dtype=np.uint32)) ^ (np.uint32(1) << rng.integers(0, bits, 3000, dtype=np.uint32))
        keys = [set(zip(*(x.tolist() for x in simhash.near_indices(s, bits)))) for s in (a, b)]
        meet = {r for r, _ in keys[0] & keys[1]}
        assert meet == set(range(3000))


def test_every_pair_within_four_bits_shares_a_key():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64)
    keys = [set(zip(*(x.tolist() for x in simhash.fuzzy_keys(s)))) for s in (a, b)]
    assert {r for r, _ in keys[0] & keys[1]} == set(range(4000))


def brute_components(prints, distance=4):
    """prints: (id, fingerprint) -> id -> least id reachable."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, p) in enumerate(prints):
        for j, q in prints[:k]:
            if (p ^ q).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in prints}


def test_links_of_random_chains_against_brute_force(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            prints.append(p)
            for _ in range(rng.randint(1, 6)):
                p ^= 1 << rng.randrange(64)
    base = rng.getrandbits(64)
    prints += [base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]  # a dense ball
    rng.shuffle(prints)
    distinct = sorted(set(prints))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in distinct], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(df)).collect()}
    want = brute_components(sorted((signed(p), p) for p in distinct))
    assert {n: found.get(n, n) for n in want} == want


def test_near_duplicates_of_texts_against_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    rows = [(None, "null id"), (0, None), (1, ""), (2, " \t"), (3, "one"), (4, "one"), (4, "one")]
    for k in range(40):
        text = [rng.choice(words) for _ in range(rng.choice((3, 60, 400)))]
        for c in range(3):
            rows.append((10 + 3 * k + c, " ".join(text)))
            text[rng.randrange(len(text))] = rng.choice(words)
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    low = -(1 << 63)
    numbered = [(low if i is None else i, plain_simhash(t)) for i, t in rows]
    want = brute_components(sorted(set(numbered)))
    assert sorted((low if r["doc_id"] is None else r["doc_id"], r["fp"] % (1 << 64), low if r["component_id"] is None else r["component_id"]) for r in got) == sorted((i, p, want[i]) for i, p in numbered)
    kept = simhash.drop_near_duplicates(docs(spark, rows)).collect()
    assert sorted(low if r["doc_id"] is None else r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_simhash_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], plain_simhash(r["text"])) for r in spark.read.parquet(sf + "/documents.parquet").collect()]
    want = brute_components(sorted(rows))
    from lexigrid.llm import queries

    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in rows}


def plain_mix(z):
    m = (1 << 64) - 1
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & m
    z = (z ^ z >> 27) * 0x94D049BB133111EB & m
    return z ^ z >> 31


def plain_shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[at : at + k]) for at in range(max(1, len(words) - k + 1))} if words else set()


def plain_wide(text, k=5, lanes=range(4)):
    """How many more shingles have each bit set than not."""
    import xxhash

    hashes = set()
    for s in plain_shingles(text, k):
        h = 0
        for w in s:
            h = (h * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(w)) % (1 << 64)
        hashes.add(h)
    rows = [[plain_mix(h ^ plain_mix(lane + 1)) for lane in lanes] for h in hashes]
    return [sum(1 if r[lane] >> b & 1 else -1 for r in rows) for lane in range(len(lanes)) for b in range(64)]


def wide_print(text, sketcher=wide_simhash.Sketcher(5)):
    return int.from_bytes(sketcher.sketch(None if text is None else text.encode())[0], "little")


@pytest.mark.parametrize("text", ["", None, " \n", "One", "a b c", "a b c d e", "A b C d e f", "É a\tb c  d\x0be f g é h", "x " * 70000, " ".join(f"w{k % 977}" for k in range(40000))])
def test_wide_fingerprint(text):
    lead = plain_wide(text)
    assert wide_print(text) == sum(1 << b for b, n in enumerate(lead) if n > 0)
    fp, found = wide_simhash.Sketcher(5).sketch(None if text is None else text.encode())
    found = np.frombuffer(found, "<u2").reshape(5, 4).tolist()
    lead = plain_wide(text, 2, range(4, 6))
    golay = simhash.golay_index()
    for k, own in enumerate(found if text and text.strip() else ()):
        part = lead[23 * k : 23 * k + 23]
        word = sum(1 << b for b, n in enumerate(part) if n > 0)
        a, b = (1 << x for x in sorted(range(23), key=lambda x: abs(part[x]))[:2])
        assert own == [golay[w] for w in (word, word ^ a, word ^ b, word ^ a ^ b)]


def alike_components(texts):
    """texts: (id, text) -> id -> least id reachable over shingle sets alike by 0.8 or more."""
    sets = [(i, plain_shingles(t, 5)) for i, t in texts]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if 10 * len(x & y) >= 8 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in sets}


def edited(rng, words, k):
    out = list(words)
    for _ in range(k):
        at = rng.randrange(len(out))
        how = rng.random()
        if how < 0.6:
            out[at] = f"new{rng.random()}"
        elif how < 0.8:
            out.pop(at)
        else:
            out.insert(at, f"new{rng.random()}")
    return out


def test_similar_documents_are_found_and_others_stay(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(4000)]
    rows, alike, apart = [], [], []
    for k in range(300):
        text = [rng.choice(words[: rng.choice((200, 4000))]) for _ in range(rng.choice((80, 300, 900)))]
        copy = edited(rng, text, max(1, len(text) // rng.choice((30, 50, 60, 90, 200))))
        a, b = plain_shingles(" ".join(text), 5), plain_shingles(" ".join(copy), 5)
        (alike if len(a & b) / len(a | b) >= 0.8 else apart).append(k)
        rows += [(k, " ".join(text)), (1000 + k, " ".join(copy))]
    got = {r["doc_id"]: r["component_id"] for r in wide_simhash.similar_documents(docs(spark, rows)).collect()}
    assert len(alike) > 200 and len(apart) > 5
    assert sum(got[1000 + k] == k for k in alike) >= 0.97 * len(alike)
    assert all(got[k] == k and got[1000 + k] in (k, 1000 + k) for k in range(300)) and all(got[1000 + k] == 1000 + k for k in apart)


def test_candidates_of_large_groups_keep_what_is_in_reach_together():
    rng = np.random.default_rng(14)
    base = rng.integers(0, 1 << 63, (4, 4), dtype=np.uint64)
    prints = base[rng.integers(0, 4, 500)] ^ np.uint64(1) << rng.integers(0, 64, (500, 4), dtype=np.uint64)
    whole = [int.from_bytes(p.tobytes(), "little") for p in prints]
    for n in (40, 500):
        for reach in (3, 6, 60):
            want = brute_components(list(enumerate(whole[:n])), reach)
            root = list(range(n))
            find = lambda i: i if root[i] == i else find(root[i])  # noqa: E731, B023
            for a, b in wide_simhash.candidates(prints[:n], 60):
                if (whole[a] ^ whole[b]).bit_count() <= reach:
                    root[max(find(a), find(b))] = min(find(a), find(b))
            assert {i: find(i) for i in range(n)} == want


def test_similar_documents_against_brute_force(spark):
    rng = random.Random(13)
    words = [f"w{k}" for k in range(300)]
    rows = [(None, "null id"), (0, None), (1, ""), (2, " \t"), (3, "one"), (4, "One"), (4, "one"), (5, "w1 " * 30000)]
    base = [rng.choice(words) for _ in range(200)]
    rows += [(10 + k, " ".join(edited(rng, base, 1))) for k in range(60)]  # a family
    for k in range(30):
        text = [rng.choice(words) for _ in range(rng.choice((3, 60, 400)))]
        for c in range(3):
            rows.append((100 + 3 * k + c, " ".join(text)))
            text = edited(rng, text, 1)
    got = wide_simhash.similar_documents(docs(spark, rows)).collect()
    low = -(1 << 63)
    numbered = [(low if i is None else i, t) for i, t in rows]
    want = alike_components(sorted(set(numbered), key=lambda r: (r[0], r[1] or "")))
    assert sorted((low if r["doc_id"] is None else r["doc_id"], low if r["component_id"] is None else r["component_id"]) for r in got) == sorted((i, want[i]) for i, _ in numbered)
    kept = wide_simhash.drop_similar(docs(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" boolean", "").split(", ")
    assert sorted(low if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert wide_simhash.similar_documents(docs(spark, [])).collect() == [] and wide_simhash.drop_similar(docs(spark, [])).collect() == []


def family(rng, size, words, swaps):
    """Texts that each differ from one base in `swaps` words of their own."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        text = list(base)
        for at in rng.sample(range(words), rng.choice(swaps)):
            text[at] = f"new{rng.random()}"
        out.append(" ".join(text))
    return out


def test_families_about_the_bar_lose_no_links(spark):
    rng = random.Random(15)
    rows = [(1000 * k + n, t) for k in range(4) for n, t in enumerate(family(rng, 100, 304, (3, 3, 4, 4, 5)))]
    want = {}
    for k in range(4):
        want |= alike_components([r for r in rows if r[0] // 1000 == k])
    got = {r["doc_id"]: r["component_id"] for r in wide_simhash.similar_documents(docs(spark, rows)).collect()}
    assert sum(got[i] != want[i] for i in want) <= 1  # the search itself is one by chance


def test_rows_left_apart_are_verified_to_the_last_pair():
    rng = random.Random(16)
    texts = family(rng, 80, 304, (3, 4, 5))
    sketcher = wide_simhash.Sketcher(5)
    fps, sets = [sketcher.sketch(t.encode())[0] for t in texts], [sketcher.shingles(t.encode()).tobytes() for t in texts]
    links = wide_simhash.tried_apart(fps, fps, sets, 256, 0.8)
    want = alike_components(list(enumerate(texts)))
    root = list(range(80))
    for a, b in links:
        a, b = sorted((root[a], root[b]))
        root = [a if r == b else r for r in root]
    assert dict(enumerate(root)) == want
    assert wide_simhash.tried_apart(fps, [fps[want[k]] for k in range(80)], sets, 256, 0.8) == []


def test_a_key_of_more_than_one_block_loses_no_links(spark):
    rng = random.Random(17)
    rows = list(enumerate(family(rng, 4600, 304, (3, 3, 4, 4, 5))))
    rng.shuffle(rows)
    got = wide_simhash.similar_documents(docs(spark, rows).repartition(3)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_blocks_of_any_size_give_the_same_components(spark, monkeypatch):
    rng = random.Random(18)
    rows = list(enumerate(family(rng, 300, 304, (3, 3, 4, 4, 5))))
    found = []
    for block, pair in ((4096, 128), (16, 8)):
        monkeypatch.setattr(wide_simhash, "TREE_BLOCK", block)
        monkeypatch.setattr(wide_simhash, "BLOCK", pair)
        rng.shuffle(rows)
        found.append({r["doc_id"]: r["component_id"] for r in wide_simhash.similar_documents(docs(spark, rows)).collect()})
    assert found[0] == found[1]


def test_a_large_group_gives_few_pairs_for_each_text(spark):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")  # a task has few keys of the group, so it gives few pairs of them twice
    try:
        for size in (200, 800):
            rows = list(enumerate(family(random.Random(size), size, 304, (1, 1, 2))))
            distinct = wide_simhash.sketches(docs(spark, rows), "doc_id", "text", 5).dropDuplicates(["fp"])
            pairs = wide_simhash.similar_pairs(distinct, wide_simhash.allowed_distance())
            assert pairs.count() <= 20 * size
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


@pytest.mark.parametrize("block", [4096, 16])
def test_pairs_of_one_label_are_left_out_and_no_others(spark, monkeypatch, block):
    monkeypatch.setattr(wide_simhash, "TREE_BLOCK", block)
    rng = np.random.default_rng(21)
    base = rng.integers(0, 1 << 63, (3, 4), dtype=np.uint64)
    prints = base[rng.integers(0, 3, 120)] ^ np.uint64(1) << rng.integers(0, 64, (120, 4), dtype=np.uint64)
    whole = sorted({p.tobytes() for p in prints})
    label = {p: int(x) for p, x in zip(whole, rng.integers(-1, 4, len(whole)))}
    label |= dict.fromkeys(whole[::2], 9)  # among them many of one label
    sources = spark.createDataFrame([(b"k%d" % (n % 4), p, label[p]) for n, p in enumerate(whole)], "source binary, fp binary, label long")
    key = lambda source: [(np.arange(len(source)), np.array([int(x[1:]) for x in source]))]
    got = wide_simhash.met(sources, 60, key).collect()
    assert all(label[r["a"]] == -1 or label[r["a"]] != label[r["b"]] for r in got)
    root = {p: p for p in whole}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    def tie(a, b):
        root[max(find(a), find(b))] = min(find(a), find(b))

    for a, b in [(p, q) for p in whole for q in whole if label[p] == label[q] != -1] + [(r["a"], r["b"]) for r in got]:
        tie(a, b)
    for a in whole:
        for b in whole:
            if whole.index(a) % 4 == whole.index(b) % 4 and (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() <= 60:
                assert find(a) == find(b)


def test_copies_edited_in_one_place_are_found(spark):
    rng = random.Random(19)
    rows, kinds = [], {"swapped": [], "appended": [], "truncated": []}
    while len(rows) < 1200:
        n, kind = len(rows) // 2, rng.choice(list(kinds))
        text = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((80, 300, 900)))]
        some = int(len(text) * rng.uniform(0.05, 0.25))
        new, at = [f"w{rng.randrange(3000)}" for _ in range(some)], rng.randrange(len(text) - some)
        copy = {"swapped": text[:at] + new[: some // 2] + text[at + some // 2 :], "appended": text + new, "truncated": text[:-some]}[kind]
        a, b = plain_shingles(" ".join(text), 5), plain_shingles(" ".join(copy), 5)
        if 0.8 <= len(a & b) / len(a | b) <= 0.86:
            kinds[kind].append(n)
            rows += [(2 * n, " ".join(text)), (2 * n + 1, " ".join(copy))]
    got = {r["doc_id"]: r["component_id"] for r in wide_simhash.similar_documents(docs(spark, rows)).collect()}
    for own in kinds.values():
        assert sum(got[2 * n + 1] == 2 * n for n in own) >= 0.97 * len(own)


@pytest.mark.parametrize("text", ["", "one", "a b c d e", " ".join(f"w{k % 977}" for k in range(9000))])
def test_bands_are_of_the_shingle_set(text):
    sketcher = wide_simhash.Sketcher(5)
    fp, found, bands = sketcher.sketch_bands(text.encode())
    bands = np.frombuffer(bands, "<i8")
    assert (fp, found) == sketcher.sketch(text.encode())
    assert len(set(bands.tolist())) == 16 and (bands < 0).all()
    assert (bands == wide_simhash.band_keys(sketcher.shingles(text.encode())[::-1])).all()


@pytest.mark.parametrize("drop", [simhash.drop_near_duplicates, wide_simhash.drop_similar])
def test_unlike_texts_under_null_and_repeated_identifiers_stay(spark, drop):
    rng = random.Random(20)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(120))
    clean = [text() for _ in range(8)]
    near = clean[4] + " end"
    rows = [(None, t) for t in clean[:4]] + [(None, clean[0]), (3, clean[4]), (7, clean[5]), (7, clean[6]), (7, clean[6]), (7, near), (9, clean[7]), (9, clean[7] + " end")]
    kept = drop(docs(spark, rows)).collect()
    linked = {t for _, t in rows} - {r["text"] for r in kept}
    assert near in linked and clean[7] + " end" in linked  # the near copy goes, the clean texts with its identifier stay
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, t) for t in clean[:4]] + [(3, clean[4]), (7, clean[5]), (7, clean[6]), (9, clean[7])])
