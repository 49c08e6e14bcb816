"""The queries of the training-data operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import chat, exact_dedup, fingerprint, langid, packing, secrets, sentencepiece, simhash, token_counts, url_filter
from lexigrid.llm import pipeline as stages
from lexigrid.llm.common import settle, shuffle_partitions, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place; tests/llm/test_text_operators.py holds it against a plain version."""
    docs = table(spark, sf_dir, "documents")
    pieces = packing.tokenize_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack_pieces(settle(pieces))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of the text they decode to; tests/llm/test_text_operators.py holds it against the library."""

    encoded = sentencepiece.encode(table(spark, sf_dir, "documents"))
    whole = encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "ids")

    def decoded(batches):
        import hashlib

        import pyarrow as pa

        bpe = sentencepiece._bpe(None)
        for batch in batches:
            sha = [hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sha, type=pa.string())], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    return whole.mapInArrow(decoded, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")


HOST_RULES = (
    url_filter.HostRule("allow", "com", "/"),
    url_filter.HostRule("block", "example.com", "/en/"),
    url_filter.HostRule("allow", "www.example.com", "/en/"),
    url_filter.HostRule("block", "net", "/es/"),
    url_filter.HostRule("block", "net", "/fr/"),
)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, url_filter.UrlFilter(HOST_RULES)).drop("url")


def _op3_sql() -> str:
    rules = " union all ".join(f"select '{r.verdict}' v, '{r.host}' h, '{r.path}' p" for r in HOST_RULES)
    quote = lambda s: s.replace("'", "''")
    hit = lambda v: " or ".join(f"regexp_matches(low, '{quote(p.pattern)}')" for p in url_filter.DEFAULT_PATTERNS if p.verdict == v) or "false"
    return f"""
    with rules as ({rules}),
    parts as (select page_id, url, case when url like '%://%' then substr(url, position('://' in url) + 3) else '' end rest,
        translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low from pages),
    cut as (select page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') path from parts),
    judged as (select *, (select max_by({{'rule': h || p, 'verdict': v}}, length(h) + length(p)) from rules
        where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) best from cut)
    select page_id, host, path, best.rule as rule,
        coalesce(best.verdict, case when ({hit("block")}) and not ({hit("allow")}) then 'block' else 'allow' end) as verdict
    from judged"""


def edited_fingerprints(docs: DataFrame, width: int = 16) -> DataFrame:
    """doc_id, n_chars, edited_sha256, digest, edited_digest, sha, edited_sha, near_edited, near_next of documents in the order of doc_id (then text).

    sha and edited_sha are 16 bytes of SHA-256 of the canonical texts, which tell
    texts apart whose other digests meet. Null texts are empty, a null doc_id
    is the first, and rows repeated in doc_id and text follow one another; each
    row gets one. Texts move once, by ranges of doc_id. A partition's last document
    meets the first of the next partition that has any in a second, small step.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = own.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    schema = "part long, edge string, doc_id long, text string, n_chars long, edited_sha256 string, digest binary, edited_digest binary, sha binary, edited_sha binary, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]

    def judged(text: str, canon: str, after: str, after_canon: str):
        import hashlib

        sha = lambda t: hashlib.sha256(t.encode("utf-8", "replace"))
        n = len(text)
        k = n // 4
        edited = text[: n - k] + after[:k]
        edited_canon = canon if edited == text else fingerprint.canonical(edited)
        return n, sha(edited).hexdigest(), fingerprint.wide_hash(canon, width), fingerprint.wide_hash(edited_canon, width), sha(canon).digest()[:16], sha(edited_canon).digest()[:16], float(canon == edited_canon), float(canon == after_canon)

    def batch_of(rows):
        import pyarrow as pa

        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * 4, pa.float64(), pa.float64())
        return pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

    def within(batches):
        part, held, out = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                canon = fingerprint.canonical(text)
                if held is None:
                    out.append((part, "first", ident, text, *[None] * 8))
                else:
                    out.append((part, None, held[0], None, *judged(held[1], held[2], text, canon)))
                held = ident, text, canon
            if out:
                yield batch_of(out)
                out = []
        if held is not None:
            yield batch_of([(part, "last", held[0], held[1], *[None] * 8)])

    def across(batches):
        for batch in batches:
            rows = [(part, None, ident, None, *judged(text, fingerprint.canonical(text), after, fingerprint.canonical(after))) for part, ident, text, after in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                yield batch_of(rows)

    light = settle(ordered.mapInArrow(within, schema))
    parts = sorted(r[0] for r in light.where("edge = 'first'").select("part").collect())  # a number for each partition, no more
    follow = spark.createDataFrame([(a, b) for a, b in zip(parts, parts[1:] + parts[:1])], "part long, next_part long")
    firsts = light.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    lasts = light.where("edge = 'last'").select("part", "doc_id", "text").join(follow, "part").join(firsts, "next_part")
    return light.where("edge is null").unionByName(lasts.select("part", "doc_id", "text", "after").mapInArrow(across, schema)).select("doc_id", *names[4:])


def op4_fingerprints(spark: SparkSession, sf_dir: str, width: int = 16) -> DataFrame:
    """Fingerprints of every text and its edited one; tests/llm/test_text_operators.py holds them against a plain version."""
    found = settle(edited_fingerprints(table(spark, sf_dir, "documents"), width))
    kinds = found.select("digest", "sha").unionByName(found.select(F.col("edited_digest").alias("digest"), F.col("edited_sha").alias("sha")))
    clash = fingerprint.suffixes(kinds, "sha")
    shown = lambda c: F.lower(F.hex(c))
    named = {"digest": shown("digest"), "edited_digest": shown("edited_digest")}
    if clash is not None:
        for digest, sha in (("digest", "sha"), ("edited_digest", "edited_sha")):
            found = found.join(clash.select(F.col("digest").alias(digest), F.col("sha").alias(sha), F.col("suffix").alias(f"{digest}_suffix")), [digest, sha], "left")
            named[digest] = F.concat(named[digest], fingerprint.suffix_text(F.col(f"{digest}_suffix")))
    return found.select("doc_id", "n_chars", "edited_sha256", named["digest"].alias("fingerprint"), named["edited_digest"].alias("edited_fingerprint"), "near_edited", "near_next")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece lengths of every document; tests/llm/test_text_operators.py holds them against greedy matching."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; tests/llm/test_text_operators.py holds all columns against plain Python."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda r: F.size(F.filter("secrets", lambda s: s["rank"] == r)).cast("long")
    base = secrets.named_spans(F.col("secrets"), (0, 1, 2))
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.named_spans(F.col("secrets")).alias("spans"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_labels(table(spark, sf_dir, "documents"), keep="largest")


OP7_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of every document; tests/llm/test_dedup.py holds all columns against brute force."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; tests/llm/test_text_operators.py asks for 0.98 right of the held-out ones."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(langid.may_train()))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", (~langid.may_train()).alias("held_out"), "lang_pred", "score", "rejected")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, formatted and read back. Each is a chain, so its one branch is chosen; rows without a conv_id are one conversation."""
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_trees(chat.threads(rows))
    turns = chat.read_turns(F.col("formatted"))
    flat = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = done.select("tree", "formatted", F.size(turns).alias("n"), flat.alias("flat"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return read.select(
        F.col("tree").alias("conv_id"),
        F.col("n").cast("long").alias("n_turns"),
        sha("flat").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha("loss").alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
with rows as (select conv_id, turn, role, text from conversations
    union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
named as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) pos,
    role is not distinct from 'assistant' loss, coalesce(role, '') role, coalesce(text, '') text from rows),
sized as (select *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\/')) + 12 + 1 + 11 n from named)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
    coalesce(sum(case when loss then length(text) end), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by pos) filter (where loss), '')) as loss_sha256, sum(n)::bigint as formatted_chars
from sized group by conv_id"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline; tests/llm/test_chat_and_pipeline.py holds it against a plain version."""
    return stages.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_packing, op2_sentencepiece, op3_url_filters, op4_fingerprints, op5_token_counts, op6_secret_scans, op7_exact_dedup, op8_simhash, op9_language_id, op10_chat_formatting, pipeline)}


def oracle() -> dict[str, str]:
    return {"op3_url_filters": _op3_sql(), "op7_exact_dedup": OP7_SQL, "op10_chat_formatting": OP10_SQL}
