"""WARC archives: writing pages as records, and reading records back by verifying their boundaries.

*Writing.* Every page is one record with its HTML, in UTF-8, as payload. Of
pages with equal payloads of at least ``min_bytes`` the one with the smallest
id is a ``response``; the others are ``revisit`` records that refer to it and
carry no payload. Records are written by Spark's text writer, one uncompressed
file per task; file systems that only Spark reaches will do.

*Reading.* The text reader cuts files at the magic line, so a file is read in
as many tasks as it has splits, and bytes come through as they are. The magic may also stand
inside a payload. Each cut is therefore only a *candidate*: its place in the
file follows from the lengths of the cuts before it, its successor from its
own headers. Pointer jumping from the start of each file marks the candidates
that the chain of records reaches; with every round the pointers reach twice as
far. Only marked candidates are records. A record whose payload holds the
magic is put together from its cuts.

A null page is an empty payload. Of repeated ids with equal payloads each is a
``response`` if it has the smallest id; null ids come last. Empty tables give
empty archives. A file that is damaged keeps the records up to the damage.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from acuity.llm import store
from acuity.llm.joins import join_grouped

# fixed values: parts of the format
MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "concat(chr(13), chr(10), chr(13), chr(10))"
_LINE = "concat(chr(13), chr(10))"


def base32_sha1(value: str) -> str:
    """Upper-case base32 of the SHA-1 of a binary SQL expression: every five hex digits are four base32 digits."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    return ("array_join(transform(sequence(0, 7), i -> translate(lpad(conv(substr(s, i * 5 + 1, 5), 16, 32), 4, '0'), "
            f"'{digits}', '{BASE32}')), '')").join([f"transform(array(sha1({value})), s -> ", ")[0]"])


def _record(response: bool) -> str:
    """Record as text, without the last line end."""
    http = ("concat('HTTP/1.1 200 OK', line, 'Content-Type: text/html; charset=utf-8', line, 'Content-Length: ', payload_bytes, end_)")
    block = f"concat({http}, html)" if response else http
    refers = "" if response else "'WARC-Refers-To: <urn:page:', coalesce(cast(refers_to as string), 'null'), '>', line, "
    kind = "response" if response else "revisit"
    head = (f"concat('{MAGIC[:-2]}', line, 'WARC-Type: {kind}', line, 'WARC-Record-ID: <urn:page:', coalesce(cast(page_id as string), 'null'), '>', line, "
            f"'WARC-Date: {DATE}', line, if(url is null, '', concat('WARC-Target-URI: ', url, line)), "
            f"'WARC-Payload-Digest: sha1:', payload_digest, line, {refers}'Content-Type: application/http; msgtype=response', line, "
            f"'Content-Length: ', octet_length({block}), end_, {block}, line)")
    return head


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes one record per row of (page_id, url, html)."""
    digest = base32_sha1("cast(html as binary)")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
                        F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20]+", "%20").alias("url"))
    rows = rows.selectExpr("page_id", "html", "url", f"{digest} as payload_digest", "octet_length(html) as payload_bytes")
    known = store.write(rows.filter(f"payload_bytes >= {int(min_bytes)}").select("page_id", "payload_digest"))
    first = known.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"))
    # only revisits are listed; with few of them the pages are not shuffled
    revisits = store.write(join_grouped(known, first, ["payload_digest"]).filter("not page_id <=> refers_to")
                           .select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to").distinct())
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    lines = joined.selectExpr("*", f"{_LINE} as line", f"{_END} as end_").selectExpr(
        f"if(_digest is null, {_record(True)}, {_record(False)}) as value")
    lines.write.option("lineSep", "\r\n").text(path)
    store.remove(known, revisits)


def _header(name: str) -> str:
    return f"nullif(regexp_extract(_head, '(?im)^{name}: *([^\\\\r\\\\n]*)', 1), '')"


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    """The cuts of all files between magic lines: file, block, _row (their order in a block), value, size."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.selectExpr("_metadata.file_path as file", "_metadata.file_block_start as block", "value").select(
        "file", "block", F.monotonically_increasing_id().alias("_row"), "value", F.octet_length("value").cast("long").alias("size"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per cut: its place, its successor and what its headers say; digest and size of a payload that it holds whole."""
    head = _cuts(spark, path).selectExpr("file", "block", "_row", "size", "value", f"substring_index(value, {_END}, 1) as _head")
    sized = head.selectExpr(
        "file", "block", "_row", "size", "_head", "cast(octet_length(_head) + 4 as bigint) as head_bytes",
        f"try_cast({_header('Content-Length')} as bigint) as block_bytes", "cast(value as binary) as raw")
    whole = sized.selectExpr("*", "if(block_bytes >= 0 and head_bytes + block_bytes <= size, substring(raw, cast(head_bytes + 1 as int), "
                                  "cast(block_bytes as int)), null) as body")
    parsed = whole.selectExpr(
        "file", "block", "_row", "size", "head_bytes", "block_bytes", f"{_header('WARC-Type')} as record_type",
        f"try_cast(regexp_extract({_header('WARC-Record-ID')}, 'urn:page:([0-9-]+)', 1) as bigint) as page_id",
        f"try_cast(regexp_extract({_header('WARC-Refers-To')}, 'urn:page:([0-9-]+)', 1) as bigint) as refers_to",
        f"regexp_extract({_header('WARC-Payload-Digest')}, 'sha1:([A-Z2-7]+)', 1) as stated_digest",
        f"substring(body, octet_length(substring_index(cast(body as string), {_END}, 1)) + 5) as payload")
    found = store.write(parsed.selectExpr(
        "file", "block", "_row", "size", "head_bytes", "block_bytes", "record_type", "page_id", "refers_to", "stated_digest",
        "cast(octet_length(payload) as bigint) as payload_bytes", f"{base32_sha1('payload')} as payload_digest"))
    # places: lengths of the cuts before, first over the blocks of a file, then over the rows of a block
    step = len(MAGIC)
    blocks = found.groupBy("file", "block").agg(F.sum(F.col("size") + step).alias("_bytes"))
    blocks = blocks.selectExpr("file", "block", "coalesce(sum(_bytes) over (partition by file order by block "
                                                "rows between unbounded preceding and 1 preceding), 0L) as _base")
    placed = found.join(blocks, ["file", "block"]).selectExpr(
        "*", f"_base - {step} + coalesce(sum(size + {step}) over (partition by file, block order by _row rows between unbounded "
             "preceding and 1 preceding), 0L) as place")
    # the first cut of a file stands before its first magic line
    return placed.filter("place >= 0").selectExpr(
        "*", f"place + {step} + head_bytes + block_bytes + 4 as successor", f"place + {step} + size as cut_end").drop("_base")


def reachable(chain: DataFrame) -> DataFrame:
    """Rows (file, place) that are reached from place 0 over (file, place, successor), by pointer jumping."""
    now = store.write(chain.selectExpr("file", "place", "successor as next", "place = 0 as reached"))
    before = -1
    while True:
        count = now.filter("reached").count()
        if count == before:
            return now.filter("reached").select("file", "place")
        before = count
        target = now.selectExpr("file", "place as next", "next as beyond")
        marks = now.filter("reached and next is not null").selectExpr("file", "next as place", "true as _mark").distinct()
        jumped = now.join(target, ["file", "next"], "left").select("file", "place", F.col("beyond").alias("next"), "reached")
        old = now
        now = store.write(jumped.join(marks, ["file", "place"], "left")
                          .selectExpr("file", "place", "next", "reached or coalesce(_mark, false) as reached"))
        store.remove(old)


def _assembled(spark: SparkSession, path: str, found: DataFrame, split: DataFrame) -> DataFrame:
    """(file, place, payload) of the records in ``split``, put together from all cuts up to their successor."""
    spans = split.select("file", F.col("place").alias("record"), "successor", "head_bytes", "block_bytes")
    # each cut belongs to the last record that starts at or before it
    starts = found.select("file", "block", "_row", "place").join(
        spans.select("file", F.col("record").alias("place"), F.col("successor").alias("_end")), ["file", "place"], "left")
    owned = starts.selectExpr(
        "file", "block", "_row", "place",
        "last_value(if(_end is not null, place, null), true) over (partition by file order by place) as record",
        "last_value(_end, true) over (partition by file order by place) as until")
    owned = owned.filter("record is not null and place < until").select("file", "block", "_row", "place", "record")
    pieces = _cuts(spark, path).select("file", "block", "_row", F.col("value").cast("binary").alias("raw")).join(
        owned, ["file", "block", "_row"])
    glue = f"cast('{MAGIC[:-2]}' as binary), cast({_LINE} as binary)"
    whole = pieces.groupBy("file", "record").agg(F.expr("array_sort(collect_list(named_struct('place', place, 'raw', raw)))").alias("cuts"))
    whole = whole.selectExpr("file", "record", "aggregate(slice(cuts, 2, greatest(size(cuts) - 1, 1)), cuts[0].raw, "
                                               f"(a, c) -> concat(a, {glue}, c.raw)) as raw")
    body = "substring(raw, cast(head_bytes + 1 as int), cast(block_bytes as int))"
    return (whole.join(spans, ["file", "record"]).selectExpr("file", "record as place", f"{body} as body")
            .selectExpr("file", "place", f"substring(body, octet_length(substring_index(cast(body as string), {_END}, 1)) + 5) as payload"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest are those of the full payload; a revisit takes them from
    the response it refers to.
    """
    found = store.write(candidates(spark, path))
    records = store.write(found.join(reachable(found.select("file", "place", "successor")), ["file", "place"]))
    split = records.filter("successor > cut_end")
    if not split.isEmpty():
        whole = _assembled(spark, path, found, split).selectExpr(
            "file", "place", "cast(octet_length(payload) as bigint) as _bytes", f"{base32_sha1('payload')} as _digest")
        records = records.join(whole, ["file", "place"], "left").withColumns(
            {"payload_bytes": F.coalesce("_bytes", "payload_bytes"), "payload_digest": F.coalesce("_digest", "payload_digest")})
    rows = records.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "stated_digest")
    responses = rows.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    held = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest"),
                            F.col("payload_bytes").alias("_bytes")).distinct()
    revisits = rows.filter("record_type = 'revisit'").join(held, ["refers_to", "stated_digest"], "left").selectExpr(
        "page_id", "_bytes as payload_bytes", "stated_digest as payload_digest", "record_type", "refers_to")
    return responses.unionByName(revisits)
