import json

import pytest
from pyspark.sql import functions as F

from postlake.functions import jsonv as jv
from postlake.operators import fields as fl
from postlake.operators import html as h

POSTING = {
    "@type": ["Thing", "JobPosting"],
    "title": " Data Engineer ",
    "hiringOrganization": {"@id": "acme", "name": ""},
    "jobLocation": {"address": {"addressLocality": "Pune", "addressRegion": "", "addressCountry": "IN"}},
    "baseSalary": {"currency": "USD", "value": {"minValue": 10, "maxValue": 20}},
    "employmentType": "FULL_TIME",
    "validThrough": "2026-05-01",
    "skills": "Python, , SQL",
}


def posting(spark, obj):
    df = spark.createDataFrame([(json.dumps(obj),)], "raw string")
    return df.select(fl.posting_fields(jv.parse(F.col("raw"))).alias("r")).select("r.*").first().asDict()


def test_posting_fields(spark):
    r = posting(spark, POSTING)
    assert r["title"] == "Data Engineer" and r["company_name"] == "acme"
    assert r["location"] == "Pune, IN" and r["salary"] == "USD 10-20"
    assert r["employment_type"] == "full_time" and r["posted_on"] == "2026-05-01"
    assert r["skills"] == ["Python", "SQL"] and r["description"] is None
    assert json.loads(r["experience"])["currency"] == "USD"


@pytest.mark.parametrize(
    "change, field, want",
    [
        ({"jobLocation": " Remote "}, "location", "Remote"),
        ({"jobLocation": {"address": {}, "name": "HQ"}}, "location", "HQ"),
        ({"jobLocation": ["x"]}, "location", None),
        ({"baseSalary": {"text": "good"}}, "salary", "good"),
        ({"baseSalary": {"value": {"minValue": 0, "maxValue": 5}}}, "salary", "5"),
        ({"baseSalary": "12"}, "salary", None),
        ({"skills": ["SQL", None, " Go "]}, "skills", ["SQL", "Go"]),
        ({"hiringOrganization": "Acme"}, "company_name", "Acme"),
        ({"employmentType": None}, "employment_type", None),
        ({"experienceRequirements": "5 years"}, "experience", "5 years"),
    ],
)
def test_posting_field_variants(spark, change, field, want):
    assert posting(spark, {**POSTING, **change})[field] == want


def test_find_posting_walks_graphs_in_order(spark):
    first = {"@type": "JobPosting", "title": "A"}
    docs = [
        (0, 0, json.dumps({"@type": "WebSite"})),
        (0, 1, json.dumps([{"@graph": [{"@type": "X"}, {"@graph": [first]}]}, {"@type": "JobPosting", "title": "B"}])),
        (0, 2, json.dumps({"@type": "JobPosting", "title": "C"})),
        (1, 0, json.dumps({"@type": "Org"})),
    ]
    df = spark.createDataFrame(docs, "page_id long, pos int, raw string").withColumn("doc", jv.parse(F.col("raw")))
    rows = fl.find_posting(df).select("page_id", F.to_json("posting").alias("p")).collect()
    assert [(r.page_id, json.loads(r.p)["title"]) for r in rows] == [(0, "A")]


def test_light_posting(spark):
    obj = {**POSTING, "jobLocationAddress": {"addressLocality": "Goa"}, "experienceRequirements": "2y"}
    df = spark.createDataFrame([(json.dumps(obj),)], "raw string")
    r = df.select(fl.posting_fields_light(jv.parse(F.col("raw")), F.lit("u")).alias("r")).first().r
    assert (r.location, r.salary, r.remote_type, r.job_link) == ("Goa", "10", "full_time", "u")


@pytest.mark.parametrize(
    "text, want",
    [
        ("Salary: 10-12 LPA plus", "Salary: 10-12 LPA plus"),
        ("we give $ 90,000 per year", "$ 90,000 per year"),
        ("nothing", None),
    ],
)
def test_salary(one, text, want):
    assert one(fl.text_salary(F.lit(text))) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Experience: 5+ years in", "Experience: 5+ years"),
        ("at least 3+ yrs", "3+ yrs"),
        ("none", None),
    ],
)
def test_experience(one, text, want):
    assert one(fl.text_experience(F.lit(text))) == want


def test_plain_text_fields(one):
    assert one(fl.text_employment_type(F.lit("This is Full  Time, hybrid"))) == "full  time"
    assert one(fl.text_employment_type(F.lit("remotely"))) is None
    assert one(fl.text_posted_date(F.lit("Posted: 12/03/2026 Monday"))) == "12/03/2026 Monday"
    assert one(fl.text_posted_date(F.lit("on 2026-03-12"))) == "26-03-12"
    assert one(fl.text_remote_type(F.lit("Work from  Home"))) == "work from  home"
    assert one(fl.text_remote_type(F.lit("x"))) == "unknown"


def test_term_tags_respect_word_boundaries(one):
    tags = one(fl.term_tags(F.lit("Go, python and Java; not JavaScripty. C++x C# gitlab éGo SQL")))
    assert tags == ["C++", "Go", "Java", "Python", "SQL"]


PAGE = (
    "<html><h1>QA</h1><h1>Lead Engineer</h1><div class='company-name'>Acme</div><span class='location'>Pune</span>"
    "<div class='job-description'>Build great <b>things</b> with Python every day of the week</div>"
    "<p>Experience: 5 years</p><p>Salary: 10 LPA fixed</p></html>"
)


def test_parse_pages(pages):
    r = fl.parse_pages(pages(PAGE, "<p>Plain line</p><p>Location: Berlin</p>")).orderBy("page_id").collect()
    assert (r[0].title, r[0].company_name, r[0].location) == ("Lead Engineer", "Acme", "Pune")
    assert r[0].description == "Build great things with Python every day of the week"
    assert r[0].experience == "Experience: 5 years" and r[0].salary == "Salary: 10 LPA fixed"
    assert r[0].skills == ["Python"]
    assert (r[1].title, r[1].location, r[1].description) == ("Plain line", "Berlin", None)


def test_description_section_of_plain_text(pages):
    # Joined text has no blank lines, so the section pattern needs a text with paragraphs.
    text = "Job Summary: " + "w" * 120 + "\n\nNext"
    df = h.read_markup(pages("<p>x</p>"), index=True)
    out = df.select(fl.html_description(F.col("dom"), F.lit(text)).alias("d")).first().d
    assert out == "w" * 120


def test_legacy_record(spark):
    df = spark.createDataFrame([(1, "https://h/1234567", PAGE)], "page_id long, url string, html string")
    r = fl.parse_pages_legacy(df).first()
    assert (r.title, r.company_name, r.locations, r.job_id) == ("QA", "Acme", ["Pune"], "1234567")
    assert r.job_summary.startswith("Build great") and r.remote_type == "unknown" and r.is_active
    assert len(r.asDict()) == 20
