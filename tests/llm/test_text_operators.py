import random
import re
import unicodedata
import zlib

import numpy as np
import pytest

from lexigrid.llm import fingerprint, langid, packing, queries, sentencepiece, token_counts, url_filter
from lexigrid.llm.secrets import KINDS, MarkovRatio, default_model, find_secrets, made_samples, named_spans, redact_secrets

SCHEMA = "doc_id long, text string, ids string, start string, n string"
ODD = ["", None, " ", "a", "Hello, World! it's 3.5 ½ ﬁ", "É\u0301 ß İstanbul Σας 一☃ \x1c\x85\xa0x", "don't <|endoftext|> stop", "tab\tnew\nline\r\x0bx", "<|im_start|> \\ <|", "word " * 3000, "x" * 5000]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def numbered(texts):
    return [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (3, texts[3])]


# packing


def test_word_bpe_is_the_library():
    from tokenizers import Tokenizer

    path = packing.vocabulary("word_bpe_49k.json")
    rng = random.Random(1)
    alphabet = list("abcdefghij ABC'.,!-0123456789 \n\táéßñÉİΣ一☃²½ªº_\x1c\x85\xa0\u2003\u0301") + ["the ", "ing", "'s", "n't", "  ", "<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "<|", "|>"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    for plain_names in (False, True):
        bpe, lib = packing.WordBpe(path, plain_names=plain_names), Tokenizer.from_file(path)
        if plain_names:
            lib.encode_special_tokens = True
        for text in texts:
            assert np.frombuffer(bpe.encode(text.encode()), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_best_fit_decreasing_picks_the_tightest_window():
    rng = random.Random(2)
    for _ in range(50):
        capacity = rng.choice((1, 7, 64, 100))
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        room, want = [], [None] * len(lengths)
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            fits = [r for r in room if r >= lengths[k]]
            if fits:
                at = room.index(min(fits))
                want[k] = room[at]
                room[at] -= lengths[k]
            else:
                want[k] = capacity
                room.append(capacity - lengths[k])
        put = packing.best_fit_decreasing(lengths, capacity)
        assert [capacity - o for _, o in put] == want
        assert len({w for w, _ in put}) == len(room)


@pytest.mark.parametrize("window,shard_rows", [(16, 5), (2048, 8192)])
def test_packing_covers_every_token_once(spark, window, shard_rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json"))
    rows = numbered(ODD)
    packed = packing.pack_documents(docs(spark, rows), window=window, shard_rows=shard_rows)
    got = packed.collect()
    want = sorted(((-1 if i is None else i), tuple(lib.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    by_doc, by_sequence = {}, {}
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] <= window
        by_doc.setdefault(-1 if r["doc_id"] is None else r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    copies = {}
    for i, ids in want:
        copies.setdefault(i, []).append(ids)
    for i, pieces in by_doc.items():
        n = len(copies[i])
        flat = [x for _, ids, _ in sorted(pieces)[::n] for x in ids]
        assert tuple(flat) == copies[i][0] and len(pieces) % n == 0 and all(d == len(flat) for *_, d in pieces)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window and all(r["sequence_tokens"] == at and r["padded_tokens"] == (at if at & (at - 1) == 0 else window) for r in own)
    whole = packing.sequences(packed).collect()
    assert len(whole) == len(by_sequence) and all(len(r["ids"]) == 4 * r["sequence_tokens"] for r in whole)
    assert packing.pack_documents(docs(spark, [])).collect() == []


def test_pieces_of_one_identifier_pack_in_bounded_blocks(spark):
    rng = random.Random(21)
    rows = [(None, 0, rng.randint(1, 60), "x") for _ in range(3000)] + [(7, 64 * k, 64, "x") for k in range(200)]
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, other string").repartition(3)
    got = packing.pack_pieces(pieces, window=64, shard_rows=100).collect()
    assert len(got) == len(rows) and sorted((r["doc_id"] or -1, r["length"]) for r in got) == sorted((d or -1, n) for d, _, n, _ in rows)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        ends = [0] + [o + n for o, n in sorted(own)]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 64
    shards = {}
    for r in got:
        shards[r["sequence_id"] >> 32] = shards.get(r["sequence_id"] >> 32, 0) + 1
    assert max(shards.values()) < 250  # null identifiers are dealt like any others


def test_packing_query(spark):
    got = queries.op1_packing(spark, "/root/testdata/sf0.001").collect()
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json"))
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = np.array(lib.encode(r["text"] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        pieces = sorted((g["start"], g["length"], g["ids_crc32"]) for g in got if g["doc_id"] == r["doc_id"])
        assert sum(n for _, n, _ in pieces) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in pieces)
    used, sequences = sum(r["length"] for r in got), {r["sequence_id"]: r["padded_tokens"] for r in got}
    assert used > 0.97 * sum(sequences.values())


# SentencePiece


def library_ids(text):
    bpe = sentencepiece._bpe(None)
    return bpe._ids(bpe.library.encode(text or ""))


@pytest.mark.parametrize("chunk,giant,block", [(64, 100, 3), (64, 100, 256), (sentencepiece.CHUNK, sentencepiece.GIANT, 256)])
def test_encoding_is_the_library_and_comes_back(spark, monkeypatch, chunk, giant, block):
    monkeypatch.setattr(sentencepiece, "BLOCK", block)
    rng = random.Random(3)
    alphabet = list("abcdeinth  \n.é一☃") + ["the", "ing "]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(90, 700))) for _ in range(60)] + ["".join(rng.choice("abth") for _ in range(900)), "▁▁ a ▁b  ▁"]
    rows = numbered(texts) + [(70, texts[-2])] * 2 + [(None, texts[-2]), (None, texts[-3])]
    encoded = sentencepiece.encode(docs(spark, rows), chunk=chunk, giant=giant)
    key = lambda i: -1 if i is None else i
    assert sorted((key(r["doc_id"]), bytes(r["ids"])) for r in encoded.collect()) == sorted((key(i), library_ids(t)) for i, t in rows)
    back = sentencepiece.decode(encoded)
    assert sorted((key(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((key(i), (t or "").replace("▁", " ")) for i, t in rows)
    assert sentencepiece.encode(docs(spark, [])).collect() == []


def test_encoding_query(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(sf + "/documents.parquet").collect():
        ids = library_ids(r["text"])
        want[r["doc_id"]] = (len(ids) // 4, zlib.crc32(ids), hashlib.sha256((r["text"] or "").replace("▁", " ").encode()).hexdigest())
    assert {r["doc_id"]: (r["n_ids"], r["ids_crc32"], r["decoded_sha256"]) for r in queries.op2_sentencepiece(spark, sf).collect()} == want


def test_scan_is_associative():
    rng = random.Random(4)
    states = [(k, "") for k in range(4)]
    matrices = [{a: {b for b in states if rng.random() < 0.4} for a in states} for _ in range(13)]
    total = matrices[0]
    want = [total]
    for m in matrices[1:]:
        total = sentencepiece._product(total, m)
        want.append(total)
    assert sentencepiece._scan(matrices) == want


# token counts


def test_counts_against_greedy_matching(spark):
    pieces = ["▁", "▁a", "▁ab", "▁abc", "b", "c", "bc", "cd", "d", "bcde", "é", "▁é", "▁!"]
    for vocabulary in (pieces, [p for p in pieces if p != "▁"]):
        match = token_counts.LongestMatch(vocabulary)
        own = set(vocabulary)

        def greedy(word):
            rest, n, first = "▁" + word, 0, True
            while rest:
                best = max((k for k in range(1, len(rest) + 1) if rest[:k] in own and (first or not rest.startswith("▁"))), default=0)
                if not best:
                    return 1
                rest, n, first = rest[best:], n + 1, False
            return n

        rng = random.Random(5)
        for _ in range(3000):
            word = "".join(rng.choice("abcdeé!") for _ in range(rng.randint(1, 12)))
            assert match.count(word) == greedy(word), word


def test_count_query_against_greedy_matching(spark):
    pieces = set(token_counts.piece_vocabulary())
    longest = max(map(len, pieces))

    def greedy(text):
        n = 0
        for word in re.findall(r"\w+|[^\w\s]", text or ""):
            rest, own, first = "▁" + word, 0, True
            while rest:
                best = max((k for k in range(1, min(longest, len(rest)) + 1) if rest[:k] in pieces and (first or rest[0] != "▁")), default=0)
                if not best:
                    own = 1
                    break
                rest, own, first = rest[best:], own + 1, False
            n += own
        return n

    got = {r["doc_id"]: r["n_tokens"] for r in queries.op5_token_counts(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got == {r["doc_id"]: greedy(r["text"]) for r in rows}
    df = docs(spark, numbered(ODD))
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(df).collect()) == sorted(greedy(t) for _, t in numbered(ODD))
    assert token_counts.count_tokens(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        token_counts.count_tokens(df, out="N")


# url filters


def test_index_finds_what_running_every_rule_finds():
    rng = random.Random(6)
    hosts = queries.HOST_RULES + (url_filter.HostRule("block", "big-casino.com", "/click/Tra"), url_filter.HostRule("allow", "example.com", ""))
    own = url_filter.UrlFilter(hosts)
    rules = [(r.verdict, re.compile(r.pattern)) for r in url_filter.DEFAULT_PATTERNS]
    tried = 0
    for _ in range(5000):
        host = rng.choice(("", "www.", "m.", "ads.", "help.")) + rng.choice(("Casino", "big-casino", "casinos", "poker", "adult-fun", "xxx-a.b", "example")) + rng.choice((".com", ".net", "-x.org", ""))
        url = rng.choice(("http://", "HTTPS://", "")) + host + rng.choice(("", "/", "/en/", "/es/1", "/click/track/1", "/wp-login.php?a", "/click/Track", "?x", "#y"))
        h, path, rule, verdict = own.judge(url)
        fit = [r for r in hosts if h and (h == r.host or h.endswith("." + r.host)) and path.startswith(r.path)]
        found = {v for v, rx in rules if rx.search(url.lower())}
        if fit:
            best = max(fit, key=lambda r: (len(r.host + r.path), len(r.host)))
            assert (rule, verdict) == (best.host + best.path, best.verdict), url
        else:
            assert (rule, verdict) == (None, "block" if found == {"block"} else "allow"), url
        tried += sum(isinstance(r, url_filter.PatternRule) for r in own.candidates(url))
    assert tried < 1.5 * 5000  # of eleven expressions a url


def test_only_rules_that_share_a_token_are_tried(monkeypatch):
    ran = []
    monkeypatch.setattr(url_filter.PatternRule, "search", property(lambda self: lambda low: ran.append(self.pattern) or re.search(self.pattern, low)))
    own = url_filter.UrlFilter(queries.HOST_RULES)
    assert all(r.tokens for r in (*queries.HOST_RULES, *url_filter.DEFAULT_PATTERNS))
    assert own.judge("https://a.org/news/casinos")[3] == "allow" and not ran
    assert own.judge("https://casino.org/news")[3] == "block" and len(ran) == 1
    assert own.judge("https://ads.org/news")[3] == "block" and len(ran) == 2
    assert own.judge("https://example.com/casino")[2] == "com/" and len(ran) == 2
    with pytest.raises(ValueError):
        url_filter.UrlFilter((), (url_filter.PatternRule("block", "[0-9]", ()),))


def test_host_rules(spark):
    want = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "no scheme/en/": ("", "", None, "allow"),
        "http://WWW.Example.com/en/a?b#c": ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
        "http://notexample.com": ("notexample.com", "", None, "allow"),
        "http://x.net/es/#top": ("x.net", "/es/", "net/es/", "block"),
        "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "http://casino.net?x://y": ("casino.net", "", None, "block"),
        "x://a://b.com/": ("a:", "//b.com/", None, "allow"),
    }
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(want)], "page_id long, url string, token string")
    got = url_filter.judge_urls(df, url_filter.UrlFilter(queries.HOST_RULES)).collect()
    assert {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == want
    assert url_filter.judge_urls(df.limit(0), url_filter.UrlFilter(queries.HOST_RULES)).collect() == []


# fingerprints


def plain_canonical(text):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold()).split())


@pytest.mark.parametrize("width", [16, 1])
def test_fingerprints_are_equal_exactly_for_equal_canonical_texts(spark, width):
    rows = numbered(ODD + ["ﬁ", "FI", " fi\u2003", "Straße", "STRASSE", "e\u0301", "É"] + [f"t{k}" for k in range(300)])
    got = fingerprint.fingerprints(docs(spark, rows), width=width).collect()
    assert len(got) == len(rows)
    prints = {}
    for r in got:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    canon = {i: plain_canonical(t) for i, t in rows}
    for i in canon:
        for j in canon:
            assert (prints[i] == prints[j]) == (canon[i] == canon[j])
    assert fingerprint.fingerprints(docs(spark, [])).collect() == []


@pytest.mark.parametrize("width", [16, 1])
def test_fingerprint_query(spark, tmp_path, width):
    import hashlib

    rows = [(2 * k, t) for k, t in enumerate(ODD + ["ﬁ", "FI", "abcd", "abcD", "abcd abcd", "same", "same"])]
    docs(spark, rows).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op4_fingerprints(spark, str(tmp_path), width).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == float(plain_canonical(t) == plain_canonical(edited)) and r["near_next"] == float(plain_canonical(t) == plain_canonical(after))
        assert (r["fingerprint"] == got[rows[(k + 1) % len(rows)][0]]["fingerprint"]) == bool(r["near_next"])
        assert (r["fingerprint"] == r["edited_fingerprint"]) == bool(r["near_edited"])
    docs(spark, [(1, "a"), (1, "b"), (None, "a"), (None, None)]).write.parquet(str(tmp_path / "repeated" / "documents.parquet"))
    again = [(r["doc_id"], r["fingerprint"]) for r in queries.op4_fingerprints(spark, str(tmp_path / "repeated"), width).collect()]
    assert len(again) == 4 and len({f for _, f in again}) == 3 and sorted((i is None) for i, _ in again) == [False, False, True, True]
    docs(spark, rows[:1]).write.parquet(str(tmp_path / "one" / "documents.parquet"))
    assert queries.op4_fingerprints(spark, str(tmp_path / "one")).count() == 1
    docs(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op4_fingerprints(spark, str(tmp_path / "none")).count() == 0


# secrets

BASE = (
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def plain_spans(text, model):
    out = [(m.start(), k, m.end()) for k, (_, rx, keep) in enumerate(BASE) for m in rx.finditer(text or "") if keep(m)]
    out += [(m.start(), 3, m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text or "") if model.is_secret(m[0])]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_against_plain_python(spark):
    rng = random.Random(7)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "passwd", "=", ":", " ", "  ", '"', "'", "abc", "é☃", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "x9-_/+", "\n", "deadbeef" * 3, "token=token=abcdef", "secret:token:abcdefgh", "kJ8dQ2xZ0vB7nM5rT1yW", "an_ordinary_identifier_name", "path/to/kJ8dQ2xZ0vB7nM5rT1yW/file"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)] + ["é password = abcdef1 " * 700]
    model = MarkovRatio(*made_samples(400))
    rows = numbered(texts)
    got = find_secrets(docs(spark, rows), model=model).select("doc_id", named_spans(__import__("pyspark").sql.functions.col("secrets")).alias("s")).collect()
    key = lambda i: -1 if i is None else i
    assert sorted((key(r["doc_id"]), r["s"]) for r in got) == sorted((key(i), plain_spans(t, model)) for i, t in rows)

    def clean(text):
        if not (found := plain_spans(text, model)):
            return text
        out, at = "", -1
        for a, b in sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in found.split(",")):
            if a > at:
                out += text[max(at, 0) : a] + "[SECRET]"
            at = max(at, b)
        return out + text[at:]

    back = redact_secrets(docs(spark, rows), model=model)
    assert back.columns == docs(spark, rows).columns
    assert sorted((key(r["doc_id"]), r["text"] or "") for r in back.collect()) == sorted((key(i), clean(t) or "") for i, t in rows)
    assert find_secrets(docs(spark, [])).collect() == [] and redact_secrets(docs(spark, [])).collect() == []


def test_markov_models_tell_random_strings_from_identifiers():
    from lexigrid.llm import secrets

    model, rng = default_model(), random.Random(99)
    bad, good = [secrets._random(rng) for _ in range(1500)], [secrets._ordinary(rng) for _ in range(1500)]
    assert sum(map(model.is_secret, bad)) > 0.95 * len(bad)
    assert sum(map(model.is_secret, good)) < 0.01 * len(good)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    glued = ["/".join(rng.choice(secrets._COMMON) for _ in range(4)) + "/" + "".join(rng.choice(letters) for _ in range(32)) for _ in range(1000)]
    assert sum(map(model.is_secret, glued)) > 0.95 * len(glued)


def test_markov_models_are_trained_on_labelled_rows(spark):
    ordinary, chance = made_samples(2000, seed=5)
    rows = [(t, False) for t in ordinary] + [(t, True) for t in chance] + [(None, True), ("x", None), ("", False), ("é" * 30, True)]
    model = MarkovRatio.train(spark.createDataFrame(rows, "text string, secret boolean"))
    ordinary, chance = made_samples(300, seed=6)
    assert sum(map(model.is_secret, chance)) > 0.9 * len(chance) and sum(map(model.is_secret, ordinary)) < 0.02 * len(ordinary)
    few = MarkovRatio.train(spark.createDataFrame(rows, "text string, secret boolean"), max_rows=10)
    assert not MarkovRatio.train(spark.createDataFrame([], "text string, secret boolean")).is_secret("a" * 30) and few.bar >= 0
    got = find_secrets(docs(spark, [(1, "key kJ8dQ2xZ0vB7nM5rT1yWq3Lp9Zx here")]), model=model).first()
    assert [s["rank"] for s in got["secrets"]] == [3]


def test_secret_query(spark):
    import hashlib

    sf, model = "/root/testdata/sf0.001", default_model()
    got = {r["doc_id"]: r for r in queries.op6_secret_scans(spark, sf).collect()}
    rows = spark.read.parquet(sf + "/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        spans = [s for s in plain_spans(r["text"], model).split(",") if s]
        base = [s for s in spans if not s.startswith("random")]
        own = got[r["doc_id"]]
        assert own["spans"] == ",".join(spans) and own["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [own["n_assign"], own["n_access"], own["n_hex"]] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]


# language identification


def test_language_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op9_language_id(spark, sf).collect()}
    rows = spark.read.parquet(sf + "/documents.parquet").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == {r["doc_id"] for r in held}
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(r["rejected"] for r in got.values()) <= 0.01 * len(got)


def test_language_edge_cases(spark):
    rng = random.Random(8)
    make = lambda s: " ".join("".join(rng.choice(s) for _ in range(2)) for _ in range(20))
    rows = [(k, make(["th", "ing", "and"]), "en") for k in range(40)] + [(100 + k, make(["sch", "ung", "ü"]), "de") for k in range(40)] + [(300, None, "en"), (301, "x", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(None, "thing and thing"), (1, ""), (2, None), (3, "123 !?"), (4, "schung " * 30000), (5, "Schung ung üsch"), (5, "Schung ung üsch")]
    got = [(r["doc_id"], r["lang_pred"], r["rejected"]) for r in langid.identify(docs(spark, tests), model).collect()]
    assert [g[1] for g in got] == ["en", "und", "und", "und", "de", "de", "de"]
    assert [g[2] for g in got][1:4] == [True] * 3
    assert langid.keep_identified(docs(spark, tests), model).columns == docs(spark, tests).columns
    same = spark.createDataFrame([(None, f"ing and thing {k}", "en") for k in range(300)] + [(None, f"schung ung {k}", "de") for k in range(300)], "doc_id long, text string, lang string")
    assert langid.train(same.unionAll(same), max_rows=100).predict(["thing and ing", "schung und ung"])[0] == ["en", "de"]
    nothing = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(docs(spark, tests), nothing).collect()} == {"und"}
    assert langid.identify(docs(spark, []), model).collect() == []
