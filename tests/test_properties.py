"""Property checks of column expressions against plain-Python models."""

import random
import re


from shelfwise.functions.text import clean_sku, norm_key


def sku_model(raw):
    if raw is None:
        return None
    s = raw.upper().strip().replace("A", "-").replace("Z", "0")
    m = re.search(r"(\d{4})", s)
    return f"SKU-{m.group(1)}" if m else s


def random_skus(n, seed):
    rnd = random.Random(seed)
    alphabet = "azAZ sku-SKU0123456789xq\t_#"
    out = []
    for _ in range(n):
        out.append("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))))
    return out + [None, "", "   ", "SKU-12345", "12", "ZZZZ", "aaaa1234"]


def test_clean_sku_matches_model(spark):
    vals = random_skus(500, 3)
    df = spark.createDataFrame([(v,) for v in vals], "raw string")
    got = [r[0] for r in df.select(clean_sku("raw")).collect()]
    assert got == [sku_model(v) for v in vals]


def test_norm_key_matches_model(spark):
    vals = random_skus(300, 5)
    df = spark.createDataFrame([(v,) for v in vals], "raw string")
    got = [r[0] for r in df.select(norm_key("raw")).collect()]
    assert got == [None if v is None else v.lower().strip() for v in vals]
