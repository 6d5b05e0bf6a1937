import random

from pyspark.sql import functions as F

from folioline.functions import text
from folioline.functions.sequences import block_ratios

SAMPLES = [
    "Delivery-Note No: 45871", "  ÉCOLE straße ½ ² İstanbul ǆ ", "a\x1cb\tc\x85d", "-_-", "",
    "Ωmega ﬁne ①", "ŉ ĳ Ŀ", "100 llamas_0", "日本 語", "é combining", "ΣΑΣ",
]


def test_builtin_and_python_normalisation_agree(spark):
    random.seed(3)
    pool = [chr(c) for c in range(1, 0x260)] + list("αβ语ﬁ①")
    texts = SAMPLES + ["".join(random.choices(pool, k=40)) for _ in range(300)]
    texts += [chr(c) for c in range(1, 0x400) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = text.normalize_column(df, "t", "n").collect()
    assert [(r.t, r.n) for r in got if r.n != text.normalize_text(r.t)] == []


def test_strip_takes_all_white_space(spark):
    df = spark.createDataFrame([("  a b\x1f\n",), (" 　",), ("",)], "t string")
    got = df.select(
        text.strip(F.col("t")).alias("s"), text.is_blank(F.col("t")).alias("b"),
        text.visible_chars(F.col("t")).alias("v"),
    ).collect()
    assert [(r.s, r.b, r.v) for r in got] == [("a b", False, 2), ("", True, 0), ("", True, 0)]


def test_similarity_is_not_symmetric():
    there, back, near = block_ratios(["tide", "diet", "delivery note no"], ["diet", "tide", "deiivery note no"])
    assert near == 0.9375 and there != back


def test_normalised_characters_beyond_latin():
    assert text.normalize_text("ﬁne Ⅷ №5 ２") == "fine viii No5 2"
    assert text.normalize_text("x\u0301\u2028y\u200bz _-01") == "x yz ol"
