"""Field, chunk and list queries over document text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import explode_rows
from postlake.operators import chunks as ck
from postlake.operators import fields as fl
from postlake.operators import payloads as pl
from postlake.operators import records as rec
from postlake.plans.registry import Tables, query

# Terms that do occur in the invented prose.
GOOD_TERMS = ("the", "tion", "license", "que", "ing")
BAD_TERMS = ("sch", "eau")
# Pattern lists that do match it; the defaults are covered by unit tests.
YEARS = (r"(?i)(the|que)\s+([a-z]+)\s+of", r"(?i)([0-9]+)\s*[a-z]+")
DATES = (r"(?i)(?:license|date)\s+([a-z]+)", r"([0-9]{1,2}[/\-.\s][0-9]{1,2})")
REMOTE = r"(?i)(license|que\s+le|onsite|the\s+of)"


def sql_first(*groups: tuple[str, int], column: str = "text") -> str:
    """SQL for the stripped group of the first matching pattern."""
    picks = [f"nullif(trim(regexp_extract({column}, '{p}', {g}), E' \\t\\n'), '')" for p, g in groups]
    return f"coalesce({', '.join(picks)}, NULL)"


def sql_list(terms: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


@query(
    "text_salary",
    f"""SELECT doc_id, {sql_first(
        (r'(?i)(?:salary|compensation|pay|ctc|package)\s*[:\-]?\s*([^\n]{5,100})', 0),
        (r'(?i)(\$|₹|EUR|USD|INR)\s*[\d,\s\-]+(?:per\s+year|per\s+month|annum|annually)?', 0))} AS salary
      FROM documents""",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fl.text_salary(F.col("text")).alias("salary"))


@query(
    "text_experience",
    f"SELECT doc_id, {sql_first(*[(p, 0) for p in YEARS])} AS experience FROM documents",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fl.text_experience(F.col("text"), YEARS).alias("experience"))


@query(
    "text_employment_type",
    rf"""SELECT doc_id, lower({sql_first((r'(?i)(?:^|[^\p{L}\p{N}_])(license|que\s+le|des|the)(?:[^\p{L}\p{N}_]|$)', 1))})
        AS employment_type FROM documents""",
)
def _(t: Tables) -> DataFrame:
    kind = fl.text_employment_type(F.col("text"), ("license", r"que\s+le", "des", "the"))
    return t.documents.select("doc_id", kind.alias("employment_type"))


@query(
    "text_posted_date",
    f"SELECT doc_id, {sql_first(*[(p, 1) for p in DATES])} AS posted_on FROM documents",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fl.text_posted_date(F.col("text"), DATES).alias("posted_on"))


@query(
    "text_remote_type",
    f"SELECT doc_id, coalesce(lower({sql_first((REMOTE, 1))}), 'unknown') AS remote_type FROM documents",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fl.text_remote_type(F.col("text"), REMOTE).alias("remote_type"))


@query(
    "tag_terms",
    r"""WITH terms AS (SELECT * FROM (VALUES
          ('the', '(?:^|[^\p{L}\p{N}_])the(?:[^\p{L}\p{N}_]|$)'), ('Que', '(?:^|[^\p{L}\p{N}_])que(?:[^\p{L}\p{N}_]|$)'),
          ('ing', '(?:^|[^\p{L}\p{N}_])ing(?:[^\p{L}\p{N}_]|$)'), ('license', '(?:^|[^\p{L}\p{N}_])license(?:[^\p{L}\p{N}_]|$)'),
          ('of.', '(?:^|[^\p{L}\p{N}_])of\.[\p{L}\p{N}_]'), ('Go', '(?:^|[^\p{L}\p{N}_])go(?:[^\p{L}\p{N}_]|$)')) v(term, pattern))
      SELECT doc_id, term FROM documents, terms WHERE regexp_matches(text, '(?i)' || pattern)""",
)
def _(t: Tables) -> DataFrame:
    tagged = fl.tag_terms(t.documents, ("the", "Que", "ing", "license", "of.", "Go"))
    return explode_rows(tagged, ["doc_id"], "tags", "term").drop("pos")


# --- Chunks -----------------------------------------------------------------

SIZE = 300
# Sentences end where a mark is followed by blanks; \x01 marks the split points, because RE2
# has no lookbehind. A list is folded into {done, cur} to pack it.
CHUNK_SQL = rf"""
  pars AS (SELECT doc_id, list_filter(list_transform(string_split(text, E'\n'),
      lambda p: trim(p, E' \t\n\r')), lambda p: p <> '') AS ps FROM documents),
  par AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM pars),
  sentences AS (SELECT doc_id, i, p, string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM par),
  folded AS (SELECT doc_id, i, p, list_reduce(
      list_transform(ss, lambda s: {{'done': []::VARCHAR[], 'cur': s}}),
      lambda a, y: CASE
        WHEN length(a.cur) + length(y.cur) <= {SIZE}
          THEN {{'done': a.done, 'cur': CASE WHEN a.cur = '' THEN y.cur ELSE a.cur || ' ' || y.cur END}}
        WHEN length(y.cur) > {SIZE}
          THEN {{'done': list_concat(CASE WHEN a.cur = '' THEN a.done ELSE list_append(a.done, a.cur) END,
            list_transform(range(0, length(y.cur), {SIZE}), lambda k: substring(y.cur, k + 1, {SIZE}))), 'cur': ''}}
        ELSE {{'done': CASE WHEN a.cur = '' THEN a.done ELSE list_append(a.done, a.cur) END, 'cur': y.cur}} END,
      {{'done': []::VARCHAR[], 'cur': ''}}) AS f FROM sentences),
  pieces AS (SELECT doc_id, i, p, CASE WHEN length(p) <= {SIZE} THEN [p]
      WHEN f.cur = '' THEN f.done ELSE list_append(f.done, f.cur) END AS subs FROM folded),
  packed AS (SELECT doc_id, list_reduce(
      list({{'done': subs, 'cur': p}} ORDER BY i),
      lambda a, y: CASE
        WHEN length(a.cur) + length(y.cur) <= {SIZE}
          THEN {{'done': a.done, 'cur': CASE WHEN a.cur = '' THEN y.cur ELSE a.cur || E'\n\n' || y.cur END}}
        WHEN length(y.cur) > {SIZE}
          THEN {{'done': list_concat(CASE WHEN a.cur = '' THEN a.done ELSE list_append(a.done, a.cur) END, y.done[1:len(y.done) - 1]),
                'cur': y.done[len(y.done)]}}
        ELSE {{'done': CASE WHEN a.cur = '' THEN a.done ELSE list_append(a.done, a.cur) END, 'cur': y.cur}} END,
      {{'done': []::VARCHAR[], 'cur': ''}}) AS f FROM pieces GROUP BY doc_id),
  chunk_lists AS (SELECT doc_id, CASE WHEN f.cur = '' THEN f.done ELSE list_append(f.done, f.cur) END AS chunks FROM packed)"""

SCORE_SQL = (
    "("
    + " + ".join(f"contains(lower(chunk), '{w}')::INTEGER" for w in GOOD_TERMS)
    + " - 2 * ("
    + " + ".join(f"contains(lower(chunk), '{w}')::INTEGER" for w in BAD_TERMS)
    + "))"
)
RANK_SQL = rf"""{CHUNK_SQL},
  chunk AS (SELECT doc_id, generate_subscripts(chunks, 1) - 1 AS pos, unnest(chunks) AS chunk FROM chunk_lists),
  scored AS (SELECT doc_id, pos, chunk, {SCORE_SQL} AS score FROM chunk),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rn FROM scored WHERE score > 0),
  top AS (SELECT doc_id, rn - 1 AS pos, chunk FROM ranked WHERE rn <= 4
    UNION ALL SELECT doc_id, 0, left(text, 1500) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ranked))"""
BUDGET_SQL = rf"""{RANK_SQL},
  trimmed AS (SELECT doc_id, pos, trim(chunk, E' \t\n\r') AS chunk FROM top),
  uniq AS (SELECT doc_id, min(pos) AS pos, chunk FROM trimmed WHERE chunk <> '' GROUP BY doc_id, chunk),
  cut AS (SELECT doc_id, pos, left(chunk, 250) AS chunk FROM uniq),
  summed AS (SELECT *, coalesce(sum(length(chunk)) OVER (PARTITION BY doc_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM cut),
  flagged AS (SELECT *, before + length(chunk) > 800 AS over,
      count(*) FILTER (before + length(chunk) > 800) OVER (PARTITION BY doc_id ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS overs FROM summed),
  kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos,
      CASE WHEN over THEN left(chunk, (800 - before)::BIGINT) ELSE chunk END AS chunk
    FROM flagged WHERE overs = 0 AND (NOT over OR 800 - before > 100))"""


@query(
    "paragraphs",
    rf"WITH {CHUNK_SQL} SELECT doc_id, i - 1 AS pos, p AS paragraph FROM par",
)
def _(t: Tables) -> DataFrame:
    return ck.paragraphs(t.documents, sep="\n")


@query(
    "pack_sentences",
    rf"""WITH {CHUNK_SQL}
      SELECT doc_id, i - 1 AS par, generate_subscripts(subs, 1) - 1 AS pos, unnest(subs) AS piece FROM pieces""",
)
def _(t: Tables) -> DataFrame:
    pars = ck.paragraphs(t.documents, sep="\n").withColumnRenamed("pos", "par")
    return ck.explode_chunks(ck.pack_sentences(pars, SIZE), "doc_id", "par", column="pieces", name="piece")


@query(
    "pack_chunks",
    rf"""WITH {CHUNK_SQL}
      SELECT doc_id, generate_subscripts(chunks, 1) - 1 AS pos, unnest(chunks) AS chunk FROM chunk_lists""",
)
def _(t: Tables) -> DataFrame:
    return ck.explode_chunks(ck.pack_chunks(t.documents, SIZE, "\n"), "doc_id")


def _scored(t: Tables) -> DataFrame:
    return ck.score_chunks(ck.pack_chunks(t.documents, SIZE, "\n"), GOOD_TERMS, BAD_TERMS)


@query("score_chunks", f"WITH {RANK_SQL} SELECT doc_id, pos, score::BIGINT AS score FROM scored")
def _(t: Tables) -> DataFrame:
    rows = explode_rows(_scored(t), ["doc_id"], "scored", "s", "_")
    return rows.select("doc_id", "s.pos", "s.score")


@query("top_chunks", f"WITH {RANK_SQL} SELECT doc_id, pos, chunk FROM top")
def _(t: Tables) -> DataFrame:
    return ck.explode_chunks(ck.top_chunks(_scored(t), 4), "doc_id")


@query("within_budget", f"WITH {BUDGET_SQL} SELECT doc_id, pos, chunk FROM kept")
def _(t: Tables) -> DataFrame:
    return ck.explode_chunks(ck.within_budget(ck.top_chunks(_scored(t), 4), 800, 250), "doc_id")


HEADING = r"""length(s) > 3 AND length(s) < 60 AND NOT regexp_matches(lower(s), 'about us|who we are|eeo')
    AND (regexp_matches(s, '^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*$')
      OR regexp_matches(s, '^[^\p{Lu}\p{Ll}\p{Lt}]*[\p{Lu}\p{Lt}]\p{Ll}*(?:[^\p{Lu}\p{Ll}\p{Lt}]+[\p{Lu}\p{Lt}]\p{Ll}*)*[^\p{Lu}\p{Ll}\p{Lt}]*$'))"""


@query(
    "next_heading",
    rf"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
            FROM (SELECT doc_id, string_split(text, E'\n') AS ls FROM documents)),
      p AS (SELECT doc_id, trim(line, E' \t\r') AS s, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM l)
      SELECT doc_id, coalesce(min(start_at) FILTER ({HEADING}), -1)::BIGINT AS heading_at FROM p GROUP BY doc_id""",
)
def _(t: Tables) -> DataFrame:
    return ck.next_heading(t.documents).select("doc_id", "heading_at")


# The section under each phrase, up to the first line that looks like a heading; else the head of the text.
SUMMARY_PHRASES, SUMMARY_CAP, SUMMARY_HEAD = ("license", "que", "the"), 300, 200
SUMMARY_SQL = rf"""
  phrases AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(SUMMARY_PHRASES))}) AS v(k, phrase)),
  under AS (SELECT doc_id, k, substring(text, position(phrase IN lower(text)) + length(phrase)) AS rest
    FROM documents, phrases WHERE position(phrase IN lower(text)) > 0),
  sections AS (SELECT doc_id, k, trim(left(CASE WHEN position(E'\n' IN rest) > 0 THEN substring(rest, position(E'\n' IN rest) + 1)
      ELSE rest END, {SUMMARY_CAP}), E' \t\n\r') AS sec FROM under),
  section_lines AS (SELECT doc_id, k, sec, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
    FROM (SELECT *, string_split(sec, E'\n') AS ls FROM sections)),
  section_starts AS (SELECT *, trim(line, E' \t\r') AS s, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, k ORDER BY i
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM section_lines),
  section_ends AS (SELECT doc_id, k, any_value(sec) AS sec, min(start_at) FILTER ({HEADING}) AS stop FROM section_starts GROUP BY ALL),
  bodies AS (SELECT doc_id, k, CASE WHEN stop IS NULL THEN sec ELSE trim(left(sec, stop::BIGINT), E' \t\n\r') END AS body FROM section_ends),
  summaries AS (SELECT d.doc_id, coalesce(b.body, trim(left(text, {SUMMARY_HEAD}), E' \t\n\r')) AS summary FROM documents d
    LEFT JOIN (SELECT doc_id, arg_min(body, k) AS body FROM bodies WHERE body <> '' GROUP BY 1) b USING (doc_id))"""


def summaries(rows: DataFrame) -> DataFrame:
    return ck.summary_section(rows, headings=SUMMARY_PHRASES, cap=SUMMARY_CAP, fallback=SUMMARY_HEAD)


@query("summary_section", f"WITH {SUMMARY_SQL} SELECT doc_id, summary FROM summaries")
def _(t: Tables) -> DataFrame:
    return summaries(t.documents).select("doc_id", "summary")


@query(
    "chunk_stats",
    rf"""WITH {BUDGET_SQL}
      SELECT d.doc_id, length(d.text) AS original_text_length, coalesce(sum(length(k.chunk)), 0)::BIGINT AS filtered_text_length,
        count(k.chunk) AS number_of_chunks_selected
      FROM documents d LEFT JOIN kept k USING (doc_id) GROUP BY d.doc_id, d.text""",
)
def _(t: Tables) -> DataFrame:
    ranked = ck.chunk_stats(
        t.documents, SIZE, 4, 800, "\n", GOOD_TERMS, BAD_TERMS, each=250
    )
    return ranked.select(
        "doc_id", "original_text_length", "filtered_text_length", "number_of_chunks_selected"
    )


# --- Lists and strings ------------------------------------------------------

WORDS_SQL = "string_split(text, ' ')"


@query(
    "distinct_ci",
    rf"""WITH w AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM (SELECT doc_id, {WORDS_SQL} AS l FROM documents)),
      s AS (SELECT doc_id, i, trim(w, E' \n') AS w FROM w WHERE trim(w, E' \n') <> ''),
      f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY i) AS k FROM s),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f WHERE k = 1)
      SELECT doc_id, n - 1 AS pos, w AS word FROM r WHERE n <= 15""",
)
def _(t: Tables) -> DataFrame:
    words = F.split("text", " ")
    return t.documents.select("doc_id", F.posexplode(rec.distinct_ci(words)).alias("pos", "word"))


@query(
    "norm_lists",
    rf"""WITH w AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM (SELECT doc_id, {WORDS_SQL} AS l FROM documents)),
      f AS (SELECT doc_id, i, trim(w, E' \n') AS w FROM w WHERE trim(w, E' \n') <> ''),
      u AS (SELECT doc_id, min(i) AS i, arg_min(w, i) AS w FROM f GROUP BY doc_id, lower(w)),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM u),
      c AS (SELECT doc_id, string_agg(w, '|' ORDER BY n) AS skills FROM r WHERE n <= 15 GROUP BY 1)
      SELECT d.doc_id, coalesce(c.skills, '') AS skills, trim(d.source) AS tools_and_technologies, '' AS benefits
      FROM documents d LEFT JOIN c USING (doc_id)""",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select(
        "doc_id", F.split("text", " ").alias("skills"), F.col("source").alias("tools_and_technologies")
    )
    out = rec.norm_lists(rows)
    return out.select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("skills", "tools_and_technologies", "benefits")])


@query(
    "norm_strings",
    """SELECT doc_id, trim(lang) AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS company_name,
        n_chars::VARCHAR AS employment_type, '' AS description FROM documents""",
)
def _(t: Tables) -> DataFrame:
    rows = t.documents.select(
        "doc_id",
        F.concat(F.lit(" \t"), F.col("lang"), F.lit(" \n")).alias("title"),
        F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("company_name"),
        F.col("n_chars").alias("employment_type"),
        F.array("lang").alias("description"),
    )
    return rec.norm_strings(rows).select("doc_id", "title", "company_name", "employment_type", "description")


@query(
    "strip_large",
    """SELECT doc_id, 0::BIGINT AS pos, lang AS section_title, text AS content FROM documents WHERE length(text) < 200
      UNION ALL SELECT doc_id, CASE WHEN length(text) < 200 THEN 1 ELSE 0 END, text, source FROM documents WHERE length(text) < 100
      UNION ALL SELECT doc_id, (length(text) < 200)::INTEGER + (length(text) < 100)::INTEGER, 'id', doc_id::VARCHAR FROM documents""",
)
def _(t: Tables) -> DataFrame:
    def section(title: Column, content: Column) -> Column:
        return F.struct(title.alias("section_title"), content.alias("content"))

    text = F.col("text")
    rows = t.documents.select(
        "doc_id",
        text.alias("description"),
        F.array(
            section(F.col("lang"), text),
            section(text, F.col("source")),
            section(F.rpad(F.col("lang"), 120, "-"), F.col("source")),
            section(F.lit("id"), F.col("doc_id").cast("string")),
        ).alias("additional_sections"),
    )
    kept = rec.strip_large(rows)
    return kept.select("doc_id", F.posexplode("additional_sections").alias("pos", "s")).select("doc_id", "pos", "s.*")


# --- Replies and prompts ----------------------------------------------------


@query(
    "token_usage",
    """SELECT conv_id, turn, (length(text) // 4)::BIGINT AS input_tokens, 0::BIGINT AS output_tokens,
        (length(text) // 4)::BIGINT AS total_tokens FROM conversations""",
)
def _(t: Tables) -> DataFrame:
    usage = pl.token_usage(t.conversations.withColumnRenamed("text", "content"))
    return usage.select("conv_id", "turn", "input_tokens", "output_tokens", "total_tokens")


@query(
    "token_usage_reported",
    """SELECT conv_id, turn, length(text) AS input_tokens, CASE WHEN role = 'user' THEN 0 ELSE turn END AS output_tokens,
        length(text) + turn AS total_tokens FROM conversations""",
)
def _(t: Tables) -> DataFrame:
    n = F.length("text")
    rows = t.conversations.select(
        "conv_id", "turn", n.alias("prompt_tokens"),
        F.when(F.col("role") != "user", F.col("turn")).alias("completion_tokens"),
        (n + F.col("turn")).alias("total_tokens"),
    )
    return pl.token_usage(rows).select("conv_id", "turn", "input_tokens", "output_tokens", "total_tokens")


@query(
    "build_prompts",
    r"""SELECT doc_id, 'Already confirmed (use these as-is, do NOT contradict):' || E'\n{\n  "language": "' || lang
          || CASE WHEN doc_id % 2 = 0 THEN E'",\n  "company": "' || source ELSE '' END || E'"\n}\n\n'
          || repeat('-', 34) || E'\n\nINPUT (FULL job posting - NO FILTERING APPLIED):\n' || text || E'\n\n'
          || repeat('-', 34) || E'\n\nOUTPUT:' AS prompt FROM documents""",
)
def _(t: Tables) -> DataFrame:
    known = F.create_map(
        F.lit("language"), F.col("lang"), F.lit("salary"), F.lit(""),
        F.lit("company"), F.when(F.col("doc_id") % 2 == 0, F.col("source")),
    )
    return pl.build_prompts(t.documents.withColumn("known", known)).select("doc_id", "prompt")


@query(
    "build_prompts_filtered",
    rf"""WITH {RANK_SQL}, {SUMMARY_SQL}, l AS (SELECT doc_id, string_agg('SECTION ' || (pos + 1) || E':\n' || chunk, E'\n\n---\n\n' ORDER BY pos) AS body FROM top GROUP BY 1)
      SELECT doc_id, repeat('-', 34) || E'\n\nINPUT (filtered to relevant job content):\nJOB SUMMARY:\n' || summary || E'\n\n---\n\n' || body
        || E'\n\n' || repeat('-', 34) || E'\n\nOUTPUT:' AS prompt FROM l JOIN summaries USING (doc_id)""",
)
def _(t: Tables) -> DataFrame:
    rows = summaries(ck.top_chunks(_scored(t), 4)).withColumn("known", F.create_map().cast("map<string,string>"))
    return pl.build_prompts(rows, mode="filtered").select("doc_id", "prompt")


@query(
    "parse_replies",
    r"""SELECT conv_id, turn, turn % 3 <> 2 AS is_valid,
        CASE WHEN turn % 3 = 2 THEN '' ELSE trim(replace(text, E'\n', ' ')) END AS title,
        CASE WHEN turn % 3 = 2 THEN '' ELSE turn::VARCHAR END AS experience,
        CASE WHEN turn % 3 = 2 THEN '' ELSE 'USD 1-2' END AS salary,
        CASE WHEN turn % 3 = 2 THEN '' ELSE role || ', IN' END AS location,
        CASE WHEN turn % 3 = 2 THEN '' ELSE 'SQL|Go' END AS required_skills,
        '' AS description, CASE WHEN turn % 3 = 2 THEN 0 ELSE 1 END::BIGINT AS sections FROM conversations""",
)
def _(t: Tables) -> DataFrame:
    body = F.to_json(
        F.struct(
            F.concat(F.lit("  "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("title"),
            F.struct(F.struct(F.col("turn").alias("minValue")).alias("value")).alias("experience"),
            F.struct(
                F.lit("USD").alias("currency"), F.struct(F.lit(1).alias("minValue"), F.lit(2).alias("maxValue")).alias("value")
            ).alias("salary"),
            F.struct(F.col("role").alias("addressLocality"), F.lit("IN").alias("addressCountry")).alias("location"),
            F.array(F.lit("SQL"), F.lit(" sql"), F.lit(""), F.lit("Go")).alias("required_skills"),
            F.lit("long text").alias("description"),
            F.array(F.struct(F.lit("a").alias("section_title"), F.lit(None).cast("string").alias("content"))).alias("additional_sections"),
        )
    )
    content = (
        F.when(F.col("turn") % 3 == 0, body)
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Sorry: "), body))
    )
    out = pl.parse_replies(t.conversations.select("conv_id", "turn", content.alias("content")))
    return out.select(
        "conv_id", "turn", "is_valid", "title", "experience", "salary",
        F.array_join("location", "|").alias("location"),
        F.array_join("required_skills", "|").alias("required_skills"),
        "description", F.size("additional_sections").alias("sections"),
    )
