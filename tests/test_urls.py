from urllib.parse import urljoin

from pyspark.sql import functions as F

from postlake.functions import urls as u

BASES = [
    "https://a.com", "https://a.com/", "https://a.com/b", "https://a.com/b/",
    "https://a.com/b/c/d?x=1#f", "http://a.com/b//c/./d", "a.com/x", "https://a.com?q=1",
]
HREFS = [
    "", "x", "./x", "../x", "../../../x", "/x", "/x/../y", "//h/p", "?q=2", "#z", "http://h/p?",
    "https://h", "mailto:a@b", "x/", "..", ".", "x//y", "/", "x?y#z", "javascript:void(0)", "/a//b/",
]


def test_absolutize_url_resolves_like_the_standard_library(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "b string, h string")
    for r in df.select("b", "h", u.absolutize_url(F.col("b"), F.col("h")).alias("r")).collect():
        base = r.b if r.b.startswith("http") else "https://" + r.b
        assert r.r == urljoin(base, r.h), (r.b, r.h)


def test_normalize_site_url(one):
    assert one(u.normalize_site_url(F.lit("  a.com/x "))) == "https://a.com/x"
    assert one(u.normalize_site_url(F.lit("http://a.com"))) == "http://a.com"
    assert one(u.normalize_site_url(F.lit(None).cast("string"))) == ""
    assert one(u.get_domain(F.lit("HTTPS.Example.com:8080/x?y"))) == "https.example.com:8080"
    assert one(u.get_origin(F.lit("https://A.com:1/x"))) == "https://A.com:1"


def test_api_looking_urls(one):
    assert one(u.looks_like_api_url(F.lit("https://x.com/GraphQL")))
    assert not one(u.looks_like_api_url(F.lit("https://x.com/about")))


def test_url_facets_drop_paging_and_blanks(one):
    url = "https://h/p?loc=a&loc=b+c&Limit=5&offset=1&e=&pct=%2Fx&bad=%zz&flag"
    assert one(u.url_facets(F.lit(url))) == {"loc": ["a", "b c"], "pct": ["/x"], "bad": ["%zz"]}


def test_workday_urls(one):
    fix = lambda s: one(u.normalize_workday_url(F.lit(s)))
    assert fix("https://t.wd1.myworkdayjobs.com/S/job/job/Pune/Eng_R1?q=1") == (
        "https://t.wd1.myworkdayjobs.com/S/en-US/job/Eng_R1"
    )
    assert fix("https://t/en-US/S/job/Pune/Eng_R1#f") == "https://t/en-US/S/job/Pune/Eng_R1"
    assert fix("https://t/S/list") == "https://t/S/list"
    assert one(u.workday_job_id(F.lit("https://t/job/AI-Eng-II_R61966-1/"))) == "_R61966-1"
    assert one(u.workday_job_id(F.lit("https://t/job/AI-Eng"))) == "AI-Eng"
    made = u.workday_job_url(F.lit("t"), F.lit("S"), F.lit(" //job-x_R1"))
    assert one(made) == "https://t.wd1.myworkdayjobs.com/en-US/S/job/job-x_R1"
    assert one(u.workday_job_url(F.lit("t"), F.lit("S"), F.lit("/"))) is None


def test_job_ids(one):
    assert one(u.job_id_from_url(F.lit("https://h/123456"))) == "123456"
    assert one(u.job_id_from_url(F.lit("https://h/1234567/apply"))) == "1234567"
    assert one(u.job_id_from_url(F.lit("https://h?reqId=AB-1"))) == "AB-1"
    assert one(u.job_id_from_url(F.lit("https://h/12345"))) == ""
    assert one(u.fallback_id(F.lit(""), F.lit("https://h/x/last"))) == "last"
