import ipaddress
import re
import unicodedata

from pyspark.sql import functions as F

from corpusmill.functions import text


def test_margin_keys_and_cells(spark):
    rows = [("Page 3 / 40",), ("- 7 -",), ("Annual  Report",), ("=SUM(A1)",)]
    d = spark.createDataFrame(rows, "x string")
    assert [r[0] for r in d.select(text.margin_key("x")).collect()] == ["#", "#", "annual report", "=sum(a1)"]
    assert d.select(text.csv_cell("x")).collect()[3][0] == "'=SUM(A1)"
    assert spark.range(1).select(text.shortened(F.lit("one two three four five"), 15)).first()[0] == "one two three…"


def test_normalised_as_all_decompositions(spark):
    """Every character of the basic plane and beyond, between letters."""
    texts = ["Česká Łódź ﬁn x² Ștefan", "İstanbul ŁÓDŹ Ｆｕｌｌ ½ ㎏ … 𝐀𝐛 K", "Ελληνικά", "plain text", "áb", "œuvre ß"]
    texts += ["".join(f"a{chr(c)}b" for c in range(low, low + 512) if not 0xD800 <= c < 0xE000) for low in (*range(0x80, 0x3400, 512), 0xFB00, 0xFE00, 0x1D400, 0x1D600, 0x1F100)]
    want = [" ".join("".join(c if c.isascii() and c.isalnum() else " " for c in unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()).split()) for t in texts]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.normalised("t").alias("n"), text.token_set("t").alias("s")).orderBy("i").collect()
    assert [r.n for r in got] == want and want[0] == "ceska odz fin x2 stefan"
    for t, r in zip(texts, got, strict=True):
        bare = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
        assert set(r.s) == {w for w in re.findall("[a-z0-9]+", bare) if len(w) > 2}
    assert set(got[0].s) == {"ceska", "odz", "fin", "stefan"}


def test_client_keys(spark):
    ips = ["2001:db8::1", "2001:db8:1:2:aaaa::1", "2001:0db8:0001:0002:0:0:0:9", "::1", "::", "::ffff:198.51.100.4", "1:0:0:2::", "1::2:3:4:5:6:7", "2001:DB8::", "198.51.100.4", "0.0.0.0", "256.1.1.1", "01.2.3.4", "1:2:3", "1::2::3", "1:2:3:4:5:6:7:8:9", "g::1", "1:2:3:4:5:6:7::8", ":1::", "", None, "2001:db8:1:2:3:4:1.2.3.4"]

    def key(ip):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return "unknown"
        return str(ipaddress.ip_network(f"{a}/64", strict=False)) if a.version == 6 else str(a)

    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i int, ip string")
    got = [r.k for r in df.select("i", text.client_key(F.col("ip")).alias("k")).orderBy("i").collect()]
    assert dict(zip(ips, got, strict=True)) == {ip: key(ip) for ip in ips}


def test_folded(spark):
    rows = [("  Straße \n ﬁn\u00ad al ", "strasse fin al"), ("ΣΊΣΥΦΟΣ", "σίσυφοσ"), ("", ""), (None, None), ("x² e\u0301", "x2 é")]
    assert [r[0] for r in spark.createDataFrame([(a,) for a, _ in rows], "t string").select(text.folded("t")).collect()] == [b for _, b in rows]
