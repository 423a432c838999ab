from pyspark.sql import functions as F

from postlake.operators import html as h

CARD = (
    '<div class="card"><h3>Senior Engineer</h3><span>Pune, India</span>'
    '<a href="/job/1">Apply Now</a></div><a href="/about">About</a>'
)


def texts(df, column="text"):
    return [r[column] for r in df.orderBy("page_id").collect()]


def test_visible_text_hides_the_named_tags(pages):
    page = "<nav>Menu</nav><p>One &amp; two</p><noscript>off</noscript><script>x()</script><iframe>f</iframe> <b>three</b>"
    assert texts(h.visible_text(pages(page), h.HIDE_NONE)) == ["Menu\nOne & two\noff\nf\nthree"]
    assert texts(h.visible_text(pages(page), h.HIDE_PAYLOAD)) == ["Menu\nOne & two\nf\nthree"]
    assert texts(h.visible_text(pages(page), h.HIDE_PARSER)) == ["Menu\nOne & two\nthree"]
    assert texts(h.visible_text(pages(page), h.HIDE_CLEANER)) == ["One & two\nthree"]


def test_unclosed_tags_keep_order_and_nest(pages):
    rows = h.html_elements(pages("<p>a<p>b</p>c<br>d</x></div>")).orderBy("pos").collect()
    assert [(r.tag, r.parent, r.text) for r in rows] == [("p", None, "a b c d"), ("p", 0, "b"), ("br", 0, "")]


def test_script_text_is_not_visible_and_markup_in_it_is_ignored(pages):
    assert texts(h.visible_text(pages('<script>var t="</p><b>no</b>";</script><p>yes'))) == ["yes"]


def test_payload_ladder(pages):
    long_text, long_markup = "word " * 120, '<div class="%s">x</div>' % ("c" * 600)
    rows = h.payload(pages(f"<p>{long_text}</p>", long_markup, "<p>short</p>", "  ")).orderBy("page_id").collect()
    assert [r.source for r in rows] == ["text", "cleaned_html", "raw_html", "empty"]
    assert rows[0].payload == long_text
    assert rows[2].payload == "<p>short</p>" and rows[3].payload == ""
    thin = h.flag_thin(h.payload(pages("<p>short</p>"))).first()
    assert thin.is_thin


def test_select_first_may_skip_or_stop_at_empty(pages):
    page = '<b class="company-name"> </b><b data-testid="company-name"></b><i class="x company">Acme</i>'
    order = ("[data-testid=company-name]", ".company-name", ".company")
    assert texts(h.select_first(pages(page), order), "value") == ["Acme"]
    assert texts(h.select_first(pages(page), order, skip_empty=False), "value") == [""]
    assert texts(h.select_first(pages(page), ("#nothing",)), "value") == [None]


def test_clean_text_drops_the_outermost_section(pages):
    page = "<div><p>Keep out</p><section>Privacy notice</section></div><p>Real job text</p><span>privacy span</span>"
    assert texts(h.clean_text(pages(page))) == ["Real job text\nprivacy span"]


def test_clean_text_cuts_at_the_last_line(pages):
    lines = "".join(f"<p>{'x' * 99}</p>" for _ in range(60))
    # 48 lines of 100 characters fill the cap exactly; the last newline is where it is cut.
    assert texts(h.clean_text(pages(lines)))[0] == "\n".join(["x" * 99] * 48)
    assert len(texts(h.clean_text(pages(lines), truncate=False))[0]) == 60 * 100 - 1
    solid = f"<p>{'y' * 6000}</p>"
    assert len(texts(h.clean_text(pages(solid)))[0]) == 4800


def test_anchors_and_listing_filters(spark):
    page = (
        '<a href="/jobs/1">Data <b>Engineer</b></a><A HREF=\'/jobs/1\'>Data Engineer</A>'
        '<a href="/privacy">Job privacy</a><a href="/x">Apply now</a><a href="/job/2">Apply now</a><a href="/y">Team</a>'
    )
    df = spark.createDataFrame([(0, "https://h.com/c", page)], "page_id long, url string, html string")
    rows = h.listings_from_anchors(df).orderBy("pos").collect()
    assert [(r.title, r.url) for r in rows] == [
        ("Data Engineer", "https://h.com/jobs/1"),
        ("Apply now", "https://h.com/job/2"),
    ]
    assert h.listings_from_anchors(df, limit=1).count() == 1


def test_cards(spark, pages):
    cards = h.card_fields(pages(CARD)).collect()
    assert [(c.title, c.href, c.location) for c in cards] == [("Senior Engineer", "/job/1", "Pune, India")]
    rows = [
        (0, 0, "https://h.com", "Engineer", "/job/1", ""),
        (0, 1, "https://h.com", "Engineer 2", "/JOB/1", ""),
        (0, 2, "https://h.com", "Saved Jobs", "/job/3", ""),
        (0, 3, "https://h.com", "Analyst", "/team/4", ""),
        (0, 4, "https://h.com", "Analyst", "/team/5", "Remote"),
        (0, 5, "https://h.com", "Analyst", "/job/6.pdf", "Remote"),
    ]
    df = spark.createDataFrame(rows, "page_id long, pos int, base_url string, title string, href string, location string")
    card = F.sort_array(F.collect_list(F.struct("pos", "title", "href", "location")))
    kept = h.listings_from_cards(df.groupBy("page_id", "base_url").agg(card.alias("cards"))).orderBy("pos").collect()
    assert [r.pos for r in kept] == [0, 4]


def plain_cards(markup):
    """Cards by their definition: every link reads all lines of the card around it."""
    from postlake.functions import lexicons as lex
    from postlake.functions.text import SPACE_CHARS

    dom = h._dom(markup)
    nodes = [t["s"] for t in dom["texts"]]
    out = []
    for a in dom["els"]:
        label = "".join(nodes[a["t0"] : a["t1"]]).strip(SPACE_CHARS)
        if a["tag"] != "a" or not a["href"] or not label or not any(t in f"{a['href']} {label}".lower() for t in lex.CARD_LINK_TOKENS):
            continue
        card = dom["els"][a["card"]] if a["card"] is not None else None
        lines = [x for s in "\n".join(nodes[card["t0"] : card["t1"]]).split("\n") if (x := s.strip(SPACE_CHARS))] if card else []
        usable = [s for s in lines if len(s) >= 6 and s.lower() != label.lower() and not any(w in s.lower() for w in lex.CARD_SKIPPED_LINES)]
        place = [
            s for s in lines[1:8]
            if len(s) > 2 and not any(w in s.lower() for w in lex.CARD_PLACE_BLOCKERS) and any("a" <= c <= "z" for c in s.lower())
            and ("," in s or any(w in s.lower() for w in lex.CARD_PLACE_WORDS))
        ]
        title = (usable or [label])[0] if label.lower() in lex.CARD_ACTION_LABELS else label
        out.append((a["pos"], title, a["href"], (place or [""])[0]))
    return out


def test_cards_equal_their_definition(pages):
    from postlake.functions import lexicons as lex

    action = sorted(lex.CARD_ACTION_LABELS)[0]
    one = f"<li><h3>Senior  Engineer</h3><p>Pune, India\n3 days ago</p><a href=/job/1>{action}</a><a href=/job/2>Engineer job</a></li>"
    same = f"<div>{action}<div><b>{action}</b><b>{action.upper()}</b><b>Data Analyst</b><a href='/job/3'>{action}</a></div>Remote, EU</div>"
    markup = [one * 3 + same, "<a href=/job/9>no card</a>", f"<div><article>{one}</article>\n x \n<p>Berlin, DE</p>{same}</div>", ""]
    got = {}
    for r in h.card_fields(pages(*markup)).collect():
        got.setdefault(r.page_id, []).append((r.pos, r.title, r.href, r.location))
    assert got == {i: want for i, m in enumerate(markup[:3]) if (want := plain_cards(m))}
    assert any(r[3] == "Pune, India" for r in got[0]) and any(r[1] == "Data Analyst" for r in got[0])


def test_one_card_of_many_links_stays_small(pages):
    import time

    def took(n):
        df = pages("<div>Pune, India<p>Remote, EU</p>" + "".join(f"<a href=/job/{i}>job {i}</a>" for i in range(n)) + "</div>")
        start = time.perf_counter()
        assert h.card_fields(df).where("location = 'Remote, EU'").count() == n
        return time.perf_counter() - start

    took(100)
    assert took(10_000) < 6 * took(5_000) + 2


def test_page_local_lists_need_no_exchange(spark, pages):
    df = pages("<a href=/job/1>Job</a>").withColumn("url", F.lit("https://h.com"))
    cards = h.read_markup(df, lines=True).withColumn("cards", h.card_array(F.col("dom"), F.col("lines"), F.col("line_at")))
    for out in (h.listings_from_anchors(df), h.listings_from_cards(cards, base="url"), h.card_fields(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_first_by_keeps_order_and_nulls(one):
    from postlake.functions.text import first_by

    items = F.array(*[F.lit(x) for x in ("b", "A", "a", None, "B", "c", None)])
    assert one(first_by(items, F.lower)) == ["b", "A", None, "c"]
    assert one(first_by(F.array().cast("array<string>"), F.lower)) == []


def test_selectors_are_looked_up(pages):
    page = "<nav><b class='x y'>hid</b></nav><b class=y id=k>one</b><i itemprop=\"jobLocation\">two</i><noscript><u role=main>n</u></noscript>"
    df = h.read_markup(pages(page, ""), index=True)
    pick = lambda s, **o: h.selector_text(F.col("dom"), s, **o)
    row = df.select(
        pick([".y"]).alias("a"), pick([".y"], hide=h.HIDE_CLEANER).alias("b"), pick([".none", '[itemprop="jobLocation"]']).alias("c"),
        pick(["[role=main]"]).alias("d"), pick(["[role=main]"], hide=h.HIDE_PARSER).alias("e"), pick(["#k", "b"]).alias("f"),
    )
    got = row.collect()
    assert tuple(got[0]) == ("hid", "one", "two", "n", None, "one") and tuple(got[1]) == (None,) * 6
    assert "filter(dom" not in row._jdf.queryExecution().optimizedPlan().toString()


def test_a_page_without_an_index_says_so(pages):
    import pytest

    df = h.read_markup(pages("<b>x</b>"))
    with pytest.raises(Exception, match="index=True"):
        df.select(h.selector_text(F.col("dom"), ["b"])).collect()


def test_ld_json_blocks_skip_bad_json(pages):
    page = (
        '<script type="application/ld+json">{bad</script><script>{"a":1}</script>'
        '<script type="application/ld+json">{"@type":"JobPosting","t":"</b>"}</script>'
    )
    rows = h.ld_json_blocks(pages(page)).collect()
    assert [(r.pos, r.raw) for r in rows] == [(1, '{"@type":"JobPosting","t":"</b>"}')]


def test_main_description_ladder(pages):
    tagged = '<div data-automation="jobPostingDescription">' + "tagged text " * 6 + "</div>"
    main = "<main><p>" + "main text " * 12 + "</p><p> </p></main>"
    lines = "<div>tiny</div><div>a line longer than ten</div>"
    out = texts(h.main_description(pages(tagged + main, main, lines)), "description")
    assert out[0].startswith("tagged") and out[1].startswith("main") and out[2] == "a line longer than ten"


def test_drop_signin(pages):
    df = pages("<a href=/Sign-In>Sign In</a>", "<a href=/sign-in>Log in</a>", "ok")
    assert [r.page_id for r in h.drop_signin(df).orderBy("page_id").collect()] == [1, 2]


def test_a_page_never_enters_a_shuffle(pages):
    from postlake.operators import fields as fl

    plan = fl.parse_pages(pages("<p>x</p>"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_odd_declarations_do_not_end_the_job(spark, pages):
    got = h.visible_text(pages("<p>a</p><![foo[bar]]><p>b</p>", "<p>good</p>", "<![if !IE]>x<![endif]>")).orderBy("page_id").collect()
    assert [r.text for r in got] == ["a\nb", "good", "x"]


def test_markup_work_grows_with_the_page():
    import time

    def took(markup):
        start = time.perf_counter()
        h._dom(markup)
        return time.perf_counter() - start

    for unit in ("<p>", "<b>x</i>", "<p>x"):
        took(unit * 2_000)
        assert took(unit * 32_000) < 8 * took(unit * 8_000) + 0.5
