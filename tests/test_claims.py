"""What texts say, on small hand-written texts."""

from lookout.functions import claims, text
from pyspark.sql import functions as F


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_payments(spark):
    p = one(spark, "Pay UPI://pay?pa=A.b%40ok&pn=X+Y&am= or a.b@ok, c-d@bank (not e@mail.example). Acct # 123 456 789 and acc. 123456789; IFSC: abcd0efgh12, 80G", claims.payments)
    assert [tuple(x) for x in p.links] == [("a.b@ok", "x y", None, None, None)]
    assert p.vpas == ["c-d@bank"] and p.accounts == ["123456789"] and p.ifsc == ["ABCD0EFGH12"] and p.donation == ["80g"]
    assert one(spark, None, claims.payments) is None or one(spark, None, claims.payments).vpas == []
    assert one(spark, "http://pay?pa=a@b", claims.payment_link) is None and one(spark, "upi://pay?pn=x", claims.payment_link) is None
    long = "give now " + "x " * 50_000 + "late@payee"
    assert one(spark, long, claims.payments).vpas == ["late@payee"]


def test_commerce_and_editorial(spark):
    c = one(spark, "US$ 5 or 7,000 rupees, $5. Checkout! CHECKOUT", claims.commerce)
    assert c.prices == ["us$ 5", "7,000 rupees", "$5"] and c.calls == ["checkout"] and c.commerce and not c.cart
    assert not one(spark, "prices 5", claims.commerce).commerce and one(spark, "View  cart", claims.commerce).cart
    e = one(spark, "An unofficial fan\npage; concerns over fraudulent fraud", claims.editorial)
    assert e.disclaimers == ["unofficial", "fan page"] and e.critical == ["concerns", "fraud"]


def test_official_claims_and_image_roles(spark):
    got = one(spark, "The Official  site of X. We aren't the official page. Nothing else.", lambda t: claims.official_claims(text.sentences(t)))
    assert [(x.sentence, x.denied) for x in got] == [("The Official  site of X.", False), ("We aren't the official page.", True)]
    assert [one(spark, t, claims.image_role) for t in ("Scan to pay", "site-LOGO.png", "favicon", "sunset", None)] == ["qr", "logo", "icon", "photo", "photo"]
