import ipaddress
import random

from pyspark.sql import functions as F

from vigilspark.operators import intel as T


def test_addresses_equal_the_python_library(spark):
    rng = random.Random(1)
    texts = ["2001:DB8::1", "::", "::1", "1::", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8:9", "1.2.3.4", "01.2.3.4", "256.1.1.1", "fe80::1%eth0", ":", "x"]
    texts += [":".join(rng.choice(["0", "0", "abcd", "01", ""]) for _ in range(rng.randint(6, 9))) for _ in range(200)]
    df = T.with_ipv6(spark.createDataFrame([(t,) for t in texts], "v string"), "v", "six").withColumn("four", T.ipv4(F.col("v")))
    for row in df.collect():
        for column, kind in (("six", ipaddress.IPv6Address), ("four", ipaddress.IPv4Address)):
            try:
                expected = str(kind(row["v"]))
            except ValueError:
                expected = None
            assert row[column] == expected


def test_malicious_wins_and_urls_match_any_known_domain(spark):
    feed = spark.createDataFrame(
        [("domain", "evil.example", "malicious", "x"), ("domain", "a.co", "benign", ""), ("domain", "evil.exampl", "benign", "")],
        "ioc_type string, ioc_value string, classification string, threat_category string",
    )
    iocs = spark.createDataFrame(
        [("url", "https://evil.example/a"), ("url", "http://a.co"), ("url", "http://b.org"), ("domain", "a.co")],
        "ioc_type string, normalized_value string",
    )
    got = {(r["ioc_type"], r["normalized_value"]): r["classification"] for r in T.ti_lookup(iocs, feed).collect()}
    assert list(got.values()).count("unknown") == 1 and got["url", "http://b.org"] == "unknown"
    assert got["url", "https://evil.example/a"] == "malicious" and got["url", "http://a.co"] == got["domain", "a.co"] == "benign"
