"""WARC archives: writing one record per page, and reading them back by verified record chains.

Writing: pages with equal payloads of at least ``least`` bytes get one response record, the one of the largest
page; the others become revisit records that name it and its digest. Records are UTF-8 text, so Spark's text writer
makes the archives, one file per task, in the shared folder.

Reading: the magic of a record may stand inside a payload, so a magic alone starts nothing. Spark's text reader
cuts the files at every magic, in splits; the parts tile a file, hence the sum of lengths before a part is its
offset. Each part is a candidate record with the offset of its successor, told by its Content-Length. Starting from
offset 0, pointer jumping (reach of 1, 2, 4, ... records per round) marks the candidates that a chain of true records
leads to. All others are payload and go back to the record that they lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kinfold.session import cut, scratch_path

MAGIC = "WARC/1.1\r\n"
LEAST = 1_000
DATE = "2024-01-01T00:00:00Z"
NAME = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def records(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, date: str = DATE) -> DataFrame:
    """``(key, record)``: the text of each page's record.

    Null payloads are empty, null urls leave out the target line, line breaks in a url are percent-encoded. Rows that
    repeat the largest id are responses as well. A page with a null id has no name and is always a response. Other columns are not read.
    """
    own = df.select(F.col(key).alias("id"), F.regexp_replace(F.regexp_replace(F.col(url), "\r", "%0D"), "\n", "%0A").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("body"))
    own = own.withColumn("size", F.octet_length("body")).withColumn("digest", F.sha1(F.col("body").cast("binary")))
    shared = own.where((F.col("size") >= least) & F.col("id").isNotNull()).groupBy("digest", "size").agg(F.max("id").alias("chief"), F.count("*").alias("n"))
    # written first, so that its size is known: a short list of shared payloads leaves the pages where they are
    shared = cut(shared.where("n > 1").select(F.col("digest").alias("d"), F.col("size").alias("s"), "chief"))
    both = own.join(shared, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")) & F.col("id").isNotNull(), "left")
    both = both.withColumn("revisits", F.coalesce(F.col("chief") != F.col("id"), F.lit(False)))
    name = lambda c: F.concat(F.lit(f"<{NAME}"), c.cast("string"), F.lit(">"))
    block = F.when(F.col("revisits"), F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("size").cast("string"), F.lit("\r\n\r\n"), F.col("body")))
    both = both.withColumn("block", block)
    line = lambda head, value: F.coalesce(F.concat(F.lit(head + ": "), value, F.lit("\r\n")), F.lit(""))
    return both.select(F.col("id").alias(key), F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(F.col("revisits"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisits"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("chief"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"), F.col("block"), F.lit("\r\n\r")).alias("record"))


def write(rows: DataFrame, path: str, record: str = "record") -> str:
    """One archive per task; the line feed that the writer adds is the last byte of a record."""
    rows.select(record).write.option("lineSep", "\n").text(path)
    return path


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics: ``(file, block, row, part)``. Rows are numbered alike in every scan of the files."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("part"))


def _framed(df: DataFrame) -> DataFrame:
    """Adds what the header of ``part`` says and, of its payload as far as the part holds it, size and digest."""
    # most headers end early; one with a long url is looked for in the whole part
    text, whole = F.substring("part", 1, 65_536).cast("string"), F.col("part").cast("string")
    until = lambda t: F.when(F.locate("\r\n\r\n", t) > 0, F.substring_index(t, "\r\n\r\n", 1))
    df = df.withColumn("head", F.coalesce(until(text), F.when(F.octet_length("part") > 65_536, until(whole))))
    length = F.regexp_extract("head", r"(?:^|\r\n)Content-Length: (\d{1,15})(?:\r|$)", 1)
    df = df.withColumn("length", F.nullif(length, F.lit("")).cast("long")).withColumn("head_bytes", F.octet_length("head"))
    df = df.withColumn("complete", F.octet_length("part") >= F.col("head_bytes") + 4 + F.col("length"))
    return df.withColumn("payload", _payload()).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", F.sha1("payload"))


def _payload() -> Column:
    """The body behind the HTTP header of a response that is complete; null if its block has no blank line."""
    block = F.substring("part", F.col("head_bytes") + 5, F.col("length").cast("int"))
    # of bytes cast to a string, what stands before the blank line keeps its bytes
    http = F.octet_length(F.substring_index(block.cast("string"), "\r\n\r\n", 1))
    body = F.when(http < F.octet_length(block), F.substring(block, http + 5, F.octet_length(block)))
    return F.when(F.col("complete") & (_header("WARC-Type") == "response"), body)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place with a magic: ``(file, at, next, end, row)``, its header and what :func:`_framed` found, without the bytes.

    ``mark`` is a hash of the part's bytes, ``at`` its offset, ``next`` that of its successor, null where no header follows, and ``end`` the file's size. An empty archive gives no rows.
    """
    size = F.octet_length("part") + len(MAGIC)
    seen = _framed(_parts(spark, path)).withColumns({"size": size, "mark": F.xxhash64("part")}).drop("part", "payload")
    seen = cut(seen)
    blocks = seen.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = F.sum("bytes").over(Window.partitionBy("file")) - len(MAGIC)  # no magic follows the last part
    blocks = blocks.select(F.col("file").alias("f"), F.col("block").alias("b"), before.alias("base"), end.alias("end"))
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("shift", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = seen.join(blocks, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    placed = placed.withColumn("at", F.col("base") + F.col("shift") - len(MAGIC)).where("at >= 0")
    following = F.col("at") + len(MAGIC) + F.col("head_bytes") + 4 + F.col("length") + 4
    return placed.withColumn("next", following).drop("f", "b", "base", "shift", "block", "size")


def reachable(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(file, at)`` of the candidates that the chain from offset 0 of each file leads to.

    Round k knows who follows 2^k records later: the reached set grows by its successors at that distance and the
    distance doubles, so rounds grow with the logarithm of the records of a file.
    """
    jump = cut(links.select("file", "at", "next"))
    reached = cut(jump.where("at = 0").select("file", "at"))
    for _ in range(max_rounds):
        step = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        grown = cut(reached.unionByName(step).distinct())
        far = jump.select(F.col("file").alias("f"), F.col("at").alias("middle"), F.col("next").alias("far"))
        jump = jump.join(far, (F.col("file") == F.col("f")) & (F.col("next") == F.col("middle"))).select("file", "at", F.col("far").alias("next"))
        jump, reached = cut(jump), grown
        if jump.isEmpty():
            return reached
    raise RuntimeError(f"chains did not end within {max_rounds} rounds")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(record_id, record_type, refers_to, target, digest, payload_bytes, payload_digest, file, row, complete)`` per true record.

    Sizes and digests are those of the payloads as they are read, null for revisits. Parts that no chain reaches are bytes
    of the record before them: such records are put together from their parts in a second scan. Headers may be of any length.
    A file whose chain does not lead to its end is refused, since pages behind the break would be missing; so are a response
    without an HTTP header and a second scan that does not see the parts of the first (files split differently since).
    """
    found = cut(candidates(spark, path))
    links = found.select("file", "at", "next").where("next is not null")
    reached = reachable(links)
    ends = found.select("file", F.col("end").alias("at")).distinct()
    cut_off = ends.join(reached, ["file", "at"], "left_anti").select("file").first()
    if cut_off:
        raise ValueError(f"{cut_off['file']}: the chain of records ends before the file does")
    true = reached.join(links.select("file", "at"), ["file", "at"], "left_semi")
    marked = found.join(true.withColumn("sound", F.lit(True)), ["file", "at"], "left")
    order = Window.partitionBy("file").orderBy("at")
    owners = marked.withColumn("owner", F.last(F.when(F.col("sound"), F.struct("at", "complete")), ignorenulls=True).over(order))
    torn = cut(owners.where(~F.col("owner.complete")).select("row", "mark", "file", "at", F.col("owner.at").alias("owner")))
    whole = marked.where("sound").drop("sound")
    if not torn.isEmpty():
        again = _parts(spark, path).select("row", F.xxhash64("part").alias("mark"), "part")
        parts = torn.join(again, ["row", "mark"], "left").groupBy("file", "owner").agg(
            F.array_sort(F.collect_list(F.struct("at", "part"))).alias("all"))
        parts = parts.withColumn("all", F.when(F.exists("all", lambda x: x["part"].isNull()), F.raise_error(
            F.lit("the files were split differently in the second scan"))).otherwise(F.col("all")))
        magic = F.lit(MAGIC).cast("binary")
        joined = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0))["part"], lambda a, x: F.concat(a, magic, x["part"]))
        mended = _framed(parts.select("file", F.col("owner").alias("at"), joined.alias("part")))
        mended = mended.select("file", "at", F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("sha"))
        whole = whole.join(mended, ["file", "at"], "left").withColumns({
            "payload_bytes": F.coalesce("bytes", "payload_bytes"), "payload_digest": F.coalesce("sha", "payload_digest")})
    lacks_http = (_header("WARC-Type") == "response") & F.col("payload_bytes").isNull()
    whole = whole.withColumn("payload_bytes", F.when(lacks_http, F.raise_error(
        F.lit("a response record without an HTTP header")).cast("long")).otherwise(F.col("payload_bytes")))
    return whole.select(
        _header("WARC-Record-ID").alias("record_id"), _header("WARC-Type").alias("record_type"), _header("WARC-Refers-To").alias("refers_to"),
        _header("WARC-Target-URI").alias("target"), F.regexp_replace(_header("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        "payload_bytes", "payload_digest", "file", "row", "complete")


def with_payloads(spark: SparkSession, path: str, got: DataFrame) -> DataFrame:
    """What :func:`read` returned with the ``payload`` itself, for records that no magic in their payload has torn."""
    bodies = _framed(_parts(spark, path)).select("row", "payload")
    return got.where("complete").join(bodies, "row")


def page_number(name: str) -> Column:
    """The page of a record name that :func:`records` made."""
    return F.expr(f"try_cast(regexp_extract(`{name}`, '^<{NAME}(-?[0-9]+)>$', 1) as bigint)")


def archive_round_trip(df: DataFrame, path: str | None = None, key: str = "page_id") -> DataFrame:
    """Writes the pages' archives and reads them back: ``(key, payload_bytes, payload_digest, record_type, refers_to)``.

    Sizes and digests of responses come from their payloads, those of revisits from the response that they name.
    """
    spark = df.sparkSession
    path = write(records(df, key), path or scratch_path(spark, "warc"))
    got = read(spark, path).select(
        page_number("record_id").alias(key), "record_type", page_number("refers_to").alias("refers_to"),
        "payload_bytes", "payload_digest")
    got = cut(got)
    full = got.where("record_type = 'response'")
    back = got.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    # the responses that are named, once each: a narrow side however many revisits there are
    named = full.join(back.select(F.col("refers_to").alias(key)).distinct(), key, "left_semi").groupBy(F.col(key).alias("refers_to")).agg(
        F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    columns = [key, "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return full.select(columns).unionByName(back.join(named, "refers_to", "left").select(columns))
