import gzip

from pyspark.sql import functions as F

from tactus.llm import warc


def brute(rows):
    out = []
    for rid, kind, url, ts, head in rows:
        if kind != "revisit":
            continue
        cands = [(t, r, h or {}) for r, k, u, t, h in rows if k == "response" and u == url and url is not None and None not in (t, ts) and t <= ts]
        head = head or {}
        if not cands:
            out.append((rid, None, "unresolved", head))
            continue
        _, r, h = max(cands, key=lambda x: x[:2])
        bare = lambda x: x.removeprefix("W/")
        outcome = "no validator"
        for name in ("etag", "last-modified"):
            if name in h and name in head:
                outcome = name if bare(h[name]) == bare(head[name]) else "mismatch"
                break
        merged = head if outcome == "mismatch" else h | {k: v for k, v in head.items() if k in warc.PERMITTED}
        out.append((rid, None if outcome == "mismatch" else r, outcome, merged))
    return sorted(out, key=str)


def test_resolve_against_brute_force(spark, rng):
    urls = ["a.org/x", "a.org/y", "b.org", None]
    rows = []
    for i in range(400):
        head = rng.choice([None, {}, {"etag": rng.choice(["1", "2"]), "x": "y"}, {"etag": "W/1", "server": "s"}, {"last-modified": rng.choice("ab"), "content-length": "9"}])
        rows.append((i, rng.choice(["response", "revisit", "request"]), "a.org/x" if rng.random() < 0.4 else rng.choice(urls), rng.choice([None, 10**6, 10**12, *range(60), *range(60)]), head))
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, headers map<string,string>").withColumn("canonical", F.lit("clash"))
    for slices in (1, 7):
        got = sorted([(r.record_id, r.resolved_id, r.outcome, r.headers) for r in warc.resolve(df, slices).collect()], key=str)
        assert got == brute(rows)
    assert warc.resolve(df.where("false")).count() == 0


def test_canonical_url(spark):
    cases = {"HTTPS://WWW.A.org:443/x/#top": "a.org/x", "http://m.a.org/x?b=2&utm_source=q&a=1": "a.org/x?a=1&b=2", "http://a.org": "a.org", "http://a.org/?ref=1": "a.org", None: None}
    got = spark.createDataFrame([(k,) for k in cases], "u string").select("u", warc.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in got} == cases


def test_read_warc(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nETag: \"x\"\r\n\r\n<html>"
    rec = lambda kind, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{kind}>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(rec("response", http)) + gzip.compress(rec("revisit", b"HTTP/1.1 304 Not Modified\r\nETag: \"x\"\r\n\r\n")))
    df = warc.read_warc(spark, str(tmp_path / "*.gz"))
    rows = {r.kind: r for r in df.collect()}
    assert rows["response"].payload == b"<html>" and rows["response"].status == 200 and rows["revisit"].status == 304
    assert rows["response"].problem is None and rows["response"].ts is not None
    r = warc.resolve(df).first()
    assert (r.resolved_id, r.outcome) == ("<response>", "etag")


def test_read_warc_plain_split_and_damaged(spark, tmp_path):
    """Plain files are split between tasks; bytes stay as they are; bad lengths and cut records are told."""
    bodies = [bytes([k % 256, 13, 10, 255]) * (k * 37 % 400) for k in range(300)]
    rec = lambda k, body, length: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: {k}\r\nContent-Length: {length}\r\n\r\n".encode() + body + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(b"".join(rec(k, b, len(b)) for k, b in enumerate(bodies)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        df = warc.read_warc(spark, str(tmp_path / "a.warc"))
        assert df.rdd.getNumPartitions() > 3
        assert {int(r.record_id): bytes(r.payload) for r in df.collect()} == dict(enumerate(bodies))
        assert df.where("problem is not null").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "b.warc").write_bytes(rec(1, b"abc", "x") + rec(2, b"abc", 99) + rec(3, b"abc", 3) + b"\r\n")
    got = {r.record_id: (r.problem, bytes(r.payload)[:3]) for r in warc.read_warc(spark, str(tmp_path / "b.warc")).collect()}
    assert got == {"1": ("length", b"abc"), "2": ("truncated", b"abc"), "3": (None, b"abc")}
    (tmp_path / "c.warc").write_bytes(b"")
    assert warc.read_warc(spark, str(tmp_path / "c.warc")).count() == 0


def test_query_has_every_outcome(spark, sf_dir):
    from tactus.llm.queries import op2_revisits

    assert {r.outcome for r in op2_revisits(spark, sf_dir).select("outcome").distinct().collect()} >= {"etag", "last-modified", "mismatch", "no validator"}


