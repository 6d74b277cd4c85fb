import pytest
from pyspark.sql import functions as F

from webmine.functions import urls as U


def one(spark, fn, value):
    df = spark.createDataFrame([(value,)], "u string")
    return df.select(fn(F.col("u")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [
    ("HTTPS://SHOP.EXAMPLE.NET/Cart", "https://shop.example.net/Cart"),
    ("https://shop.example.net:443/cart", "https://shop.example.net/cart"),
    ("http://shop.example.net/cart//", "http://shop.example.net/cart"),
    ("http://h.test/a/./b/../c/", "http://h.test/a/c"),
    ("http://h.test/?z=1&a=2&a=1", "http://h.test?a=1&a=2&z=1"),
    ("http://h.test/x%2dy", "http://h.test/x-y"),
    ("http://h.test/café", "http://h.test/caf%C3%A9"),
    ("http://3232235521/", "http://192.168.0.1"),
    ("http://h.test/bad%zz", None),
    ("http://h.test/caf%e9", "http://h.test/caf%E9"),
    ("http://h.test/caf%E8/%41%2d", "http://h.test/caf%E8/A-"),
    ("http://h.test/a%0A", "http://h.test/a%0A"),
    ("http://h.test/a/%0a", "http://h.test/a/%0A"),
    ("http://h.test/%2541?k=%e9&j=%20+%2B", "http://h.test/%2541?j=+++%2B".replace("+++", "++") + "&k=%E9"),
    ("http://h.test/?k%E9=1#f%E9", "http://h.test?k%E9=1#f%E9"),
    ("http://99999999999/", "http://99999999999"),
])
def test_canonical(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "u string")
    assert U.with_canonical(df, "u", "c").first()["c"] == want


@pytest.mark.parametrize("raw,want", [
    ("http://shop.example.net", "http://shop.example.net/"),
    ("shop.example.net", "http://shop.example.net/"),
    ("http://shop.example.net/docs", "http://shop.example.net/docs/"),
    ("http://shop.example.net/docs/app.js", "http://shop.example.net/docs/app.js"),
    ("http://shop.example.net//a//b?x=1", "http://shop.example.net/a/b?x=1"),
])
def test_queue_form(spark, raw, want):
    assert one(spark, U.clean_url, raw) == want


@pytest.mark.parametrize("path,want", [
    ("/plain/route", False),
    ("/a/b/c/d/e", False),
    ("/loop" * 10, True),
    ("", False),
    ("/alone", False),
])
def test_trap(spark, path, want):
    assert one(spark, U.is_trapped, path) is want


@pytest.mark.parametrize("s,want", [
    ("image/png", True), ("audio/ogg", True), ("video/webm", True), ("text/html", True),
    ("/some/route", False), ("scripting", False),
])
def test_mime_like(spark, s, want):
    assert one(spark, U.is_mime_like, s) is want


@pytest.mark.parametrize("s,want", [
    ("bundle.js", True), ("/static/app.min.css", True), ("/pics/cat.jpeg", True), ("/pkg/archive.tar.bz2", True),
    ("/static/lib.js?v=2.1", True), ("/checkout", False), ("readme", False), ("notes.md?a=b&c=d", True),
    ("/icons/star.svg#x", True), ("/guide/intro#part", False), ("/theme.css/", True), ("/folder/", False),
    ("/one/two/", False), ("doc%2Epdf", False), ("/p/with%2Edots%2Ehere", False),
    ("https://site.test/js/main.js", True), ("https://site.test/no/ext/here", False), ("", False), ("?k=v", False),
    ("#anchor", False),
])
def test_has_extension(spark, s, want):
    assert one(spark, U.has_extension, s) is want
