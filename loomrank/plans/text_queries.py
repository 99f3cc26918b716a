"""Queries over the text and score functions, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..functions import vocab as V
from .profiles import JD, JD_SKILLS, PROFILES_SQL, SKILLS, SNIPPETS, profiles
from .registry import lit, query, sql_list, table

P = f"WITH {PROFILES_SQL} "
C = F.col
W = r"\p{L}\p{N}_"
YEAR = 2026


def squash_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def clean_sql(x: str) -> str:
    return squash_sql(rf"regexp_replace(lower({x}), '[^{W}\s+#.]', ' ', 'g')")


def joined(c):
    return F.array_join(c, "|")


def joined_sql(x: str) -> str:
    return f"array_to_string({x}, '|')"


def words_sql(x: str, words: list[str]) -> str:
    return f"list_filter({sql_list(sorted(set(words)))}, lambda w: contains({x}, w))"


def whole_sql(x: str, words: list[str]) -> str:
    return rf"list_filter(list_filter({sql_list(sorted(set(words)))}, lambda w: contains({x}, w)), lambda w: regexp_matches({x}, '(^|[^{W}])' || regexp_escape(w) || '($|[^{W}])'))"


def simple(name: str, column, sql: str, source: str = "profiles", out: str = "value"):
    """A query of one function over every document (or profile)."""

    def run(spark, sf_dir):
        df = profiles(spark, sf_dir) if source == "profiles" else table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        return df.select("doc_id", column().alias(out))

    start = P + "SELECT" if source == "profiles" else "WITH p AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) SELECT"
    query(name, f"{start} doc_id, {sql} AS {out} FROM p")(run)


simple("clean_text", lambda: F.md5(X.clean_text(C("text"))), f"md5({clean_sql('text')})", "documents")
simple("clean_text_v2", lambda: F.md5(X.clean_text_ascii(C("text"))), "md5(" + squash_sql(r"regexp_replace(regexp_replace(lower(text), '(\d)\.(\d)', '\1DOT\2', 'g'), '[^a-z0-9\s]', ' ', 'g')") + ")")
def whole_word_sql(x: str, pattern: str, by: str) -> str:
    """A replacement between non-word characters; the second pass finds what shares its left one with the match before."""
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|[^{W}]){pattern}($|[^{W}])', '{by}', 'g')"
    return x


simple("fix_numbers", lambda: F.md5(X.fix_numbers(X.clean_text(C("text")))), "md5(" + whole_word_sql(whole_word_sql(clean_sql("text"), r"([0-4])\s+([0-9]{2})", r"\1\2.\3\4"), r"([0-9])\s+00", r"\1\2.00\3") + ")")
_exp = "lower(text)"
for _k, _v in V.ABBREVIATIONS.items():
    _exp = whole_word_sql(_exp, _k, rf"\1{_v}\2")
simple("expand_abbrev", lambda: F.md5(X.expand_abbreviations(C("text"))), f"md5({_exp})")
simple("skills_keyword", lambda: joined(X.found_words(F.lower(C("text")), V.SKILL_WORDS)), joined_sql(words_sql("lower(text)", V.SKILL_WORDS)))
simple("skills_v1", lambda: joined(X.found_words(F.lower(C("text")), V.SKILL_WORDS_V1)), joined_sql(words_sql("lower(text)", V.SKILL_WORDS_V1)))
simple("skills_phrase", lambda: joined(X.found_words(F.lower(C("text")), SKILLS, whole=True)), joined_sql(whole_sql("lower(text)", SKILLS)))
simple("years_experience", lambda: X.experience_years(C("text")), r"coalesce(list_max(list_transform(regexp_extract_all(lower(text), '(\d+)\+?\s*(?:years?|yrs?)(?:\s+of)?\s+experience', 1), lambda x: x::INT)), 0)")
simple("years_any", lambda: X.any_years(C("text")), r"list_max(list_transform(regexp_extract_all(lower(text), '(\d+(?:\.\d+)?)\s*\+?\s*(?:years|yrs|year)', 1), lambda x: x::DOUBLE))")
_YEARS = r"list_transform(regexp_extract_all(text, '\b(20[0-9]{2})\b', 1), lambda y: y::INT)"
simple("years_span", lambda: X.year_span(C("text"), YEAR), f"coalesce(list_max(list_filter({_YEARS}, lambda y: y >= 2010 AND y <= {YEAR + 1})) - list_min(list_filter({_YEARS}, lambda y: y >= 2010 AND y <= {YEAR + 1})), 0)")
_GRADES = r"list_transform(list_zip(regexp_extract_all(text, '(\d\.\d+)\s*(\d{1,3}\.?\d*)', 1), regexp_extract_all(text, '(\d\.\d+)\s*(\d{1,3}\.?\d*)', 2)), lambda p: p[1]::DOUBLE / nullif(p[2]::DOUBLE, 0))"
simple("cgpa", lambda: X.grade(C("text")), f"round(list_filter({_GRADES}, lambda x: x IS NOT NULL AND x <= 1)[1], 3)")
simple("tokenize", lambda: joined(X.tokens(C("text"))), joined_sql(f"regexp_extract_all(lower(text), '[{W}]+')"))
simple("content_id", lambda: X.content_id(C("text")), "substr(sha256(text), 1, 16)", "documents")
simple("prompt_squash", lambda: X.prompt_squash(C("text")), f"CASE WHEN length({squash_sql('text')}) > 600 THEN substr({squash_sql('text')}, 1, 600) || '...' ELSE {squash_sql('text')} END", "documents")
simple("first_words", lambda: F.lower(X.first_words(C("text"))), f"lower(array_to_string(string_split({squash_sql('text')}, ' ')[1:2], ' '))", "documents")


def section_sql(x: str, starts: list[str], ends: list[str]) -> str:
    at = "coalesce(" + ", ".join(f"nullif(position({lit(s)} IN lower({x})), 0)" for s in starts) + ")"
    stop = "least(" + ", ".join(f"nullif(position({lit(e)} IN rest), 0)" for e in ends) + ")"
    return f"(SELECT coalesce(substr(lower({x}), st, coalesce({stop}, length(lower({x})) + 1)), '') FROM (SELECT st, substr(lower({x}), st + 1) AS rest FROM (SELECT {at} AS st)))"


EXPERIENCE_SQL = section_sql("text", V.EXPERIENCE_STARTS, V.EXPERIENCE_ENDS)
PROJECTS_SQL = section_sql("text", V.PROJECT_STARTS, V.PROJECT_ENDS)
simple("section_experience", lambda: X.section(C("text"), V.EXPERIENCE_STARTS, V.EXPERIENCE_ENDS), EXPERIENCE_SQL)
simple("section_experience_v1", lambda: X.section(C("text"), V.EXPERIENCE_STARTS_V1, V.EXPERIENCE_ENDS_V1), section_sql("text", V.EXPERIENCE_STARTS_V1, V.EXPERIENCE_ENDS_V1))
simple("section_projects", lambda: X.section(C("text"), V.PROJECT_STARTS, V.PROJECT_ENDS), PROJECTS_SQL)


def split_sql(x: str, pattern: str, least: int) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({x}, '{pattern}'), lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: length(t) > {least})"


simple("split_projects", lambda: F.array_join(X.split_projects(X.section(C("text"), V.PROJECT_STARTS, V.PROJECT_ENDS)), "|"), joined_sql(split_sql(PROJECTS_SQL, r"\n\s*\n|•|-|\d+\.", 40)))
simple("split_projects_lines", lambda: F.array_join(X.split_projects_lines(X.section(C("text"), V.PROJECT_STARTS, V.PROJECT_ENDS)), "|"), joined_sql(split_sql(PROJECTS_SQL, r"\n|project", 30)))


def cues_sql(x: str, cues: list[str], width: int) -> str:
    return f"array_to_string(list_transform(list_filter({sql_list(cues)}, lambda q: contains(lower({x}), q)), lambda q: substr({x}, position(q IN lower({x})), {width})), chr(10))"


REQUIRED_SQL = f"coalesce(nullif({cues_sql('text', V.REQUIRED_CUES, V.REQUIRED_WINDOW)}, ''), text)"
PREFERRED_SQL = cues_sql("text", V.PREFERRED_CUES, V.PREFERRED_WINDOW)


@query("jd_sections", P + f"SELECT doc_id, {REQUIRED_SQL} AS required_text, {PREFERRED_SQL} AS preferred_text FROM p")
def jd_sections(spark, sf_dir):
    return profiles(spark, sf_dir).select("doc_id", X.required_text(C("text")).alias("required_text"), X.preferred_text(C("text")).alias("preferred_text"))


@query("jd_requirements", P + f""", a AS (SELECT doc_id, {words_sql('lower(text)', SKILLS)} AS skills, lower({REQUIRED_SQL}) AS r, lower({PREFERRED_SQL}) AS f FROM p),
b AS (SELECT doc_id, skills, f, CASE WHEN len(list_filter(skills, lambda s: contains(r, s))) > 0 THEN list_filter(skills, lambda s: contains(r, s)) ELSE skills[1:10] END AS req FROM a)
SELECT doc_id, {joined_sql('req')} AS required_skills, {joined_sql('list_filter(skills, lambda s: contains(f, s) AND NOT list_contains(req, s))')} AS preferred_skills FROM b""")
def jd_requirements(spark, sf_dir):
    return requirements(profiles(spark, sf_dir), C("text")).select("doc_id", joined("required_skills").alias("required_skills"), joined("preferred_skills").alias("preferred_skills"))


def requirements(df, text, words=SKILLS):
    """required_skills and preferred_skills of each row by the windows of cues."""
    skills = X.found_words(F.lower(text), words)
    df = df.withColumn("skills", skills).withColumn("r", F.lower(X.required_text(text))).withColumn("f", F.lower(X.preferred_text(text)))
    hit = F.filter("skills", lambda s: F.contains(C("r"), s))
    df = df.withColumn("required_skills", F.when(F.size(hit) > 0, hit).otherwise(F.slice("skills", 1, 10)))
    return df.withColumn("preferred_skills", F.filter("skills", lambda s: F.contains(C("f"), s) & ~F.array_contains(C("required_skills"), s))).drop("r", "f")


def domains_sql(x: str) -> str:
    names = sorted({*V.SKILL_DOMAINS, *V.DOMAIN_WORDS})
    cases = ", ".join(f"CASE WHEN len({words_sql(f'lower({x})', [*V.SKILL_DOMAINS.get(d, []), *V.DOMAIN_WORDS.get(d, [])])}) > 0 THEN {lit(d)} END" for d in names)
    return f"coalesce(nullif(list_filter([{cases}], lambda d: d IS NOT NULL), []::VARCHAR[]), ['General'])"


simple("domains", lambda: joined(X.domains(C("text"))), joined_sql(domains_sql("text")))
_FIELD = "CASE w " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.FIELD_FORMS.items()) + " ELSE w END"
DEGREES_SQL, FIELDS_SQL = whole_sql("lower(text)", V.DEGREES), f"list_sort(list_distinct(list_transform({whole_sql('lower(text)', V.FIELDS)}, lambda w: {_FIELD})))"


def fields_of(c):
    forms = X.mapping(V.FIELD_FORMS)
    return F.array_sort(F.array_distinct(F.transform(X.found_words(F.lower(c), V.FIELDS, whole=True), lambda w: F.coalesce(F.element_at(forms, w), w))))


@query("education_extract", P + f"SELECT doc_id, {joined_sql(DEGREES_SQL)} AS degrees, {joined_sql(FIELDS_SQL)} AS fields, {joined_sql(words_sql('lower(text)', V.EDUCATION_WORDS_V1))} AS words_v1 FROM p")
def education_extract(spark, sf_dir):
    return profiles(spark, sf_dir).select("doc_id", joined(X.found_words(F.lower(C("text")), V.DEGREES, whole=True)).alias("degrees"), joined(fields_of(C("text"))).alias("fields"), joined(X.found_words(F.lower(C("text")), V.EDUCATION_WORDS_V1)).alias("words_v1"))


_STEM = r"trim(regexp_replace(regexp_replace(regexp_extract(f, '([^/]*)$', 1), '\.[^.]*$', ''), '\(\d+\)$', ''))"
_STEM = rf"regexp_replace(translate({_STEM}, '_-', '  '), '(?i)({'|'.join(V.FILE_NOISE)})', ' ', 'g')"
_STEM = squash_sql(rf"regexp_replace({_STEM}, '(?i)[a-z]{{0,3}}\d{{5,}}', ' ', 'g')")
_TITLE = "array_to_string(list_transform({0}, lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
FILE_FORMS = ["/in/{a}_{b}_Resume(2).pdf", "{a}-{b}.docx", "MT2023{i}_{a}{b}.PDF", "x/{a} {b} final.pdf"]
FIRST, LAST = ["ana", "BEN", "Chloe", "dev", "éva"], ["silva", "Osei", "MARTIN", "kumar"]


def _file(parts):
    return F.concat(*[C(p[1:]) if p.startswith("$") else F.lit(p) for p in parts])


_FILES_SQL = f"f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/in/' || a || '_' || b || '_Resume(2).pdf' WHEN 1 THEN a || '-' || b || '.docx' WHEN 2 THEN 'MT2023' || (10000 + doc_id) || '_' || a || b || '.PDF' ELSE 'x/' || a || ' ' || b || ' final.txt' END AS f FROM (SELECT doc_id, ({sql_list(FIRST)})[doc_id % 5 + 1] AS a, ({sql_list(LAST)})[doc_id // 5 % 4 + 1] AS b FROM documents))"


def files(spark, sf_dir):
    """An invented file name for each document."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.get(X.strings(FIRST), (C("doc_id") % 5).cast("int")).alias("a"), F.get(X.strings(LAST), (F.floor(C("doc_id") / 5) % 4).cast("int")).alias("b"), (C("doc_id") + 10000).cast("string").alias("i"))
    forms = [["/in/", "$a", "_", "$b", "_Resume(2).pdf"], ["$a", "-", "$b", ".docx"], ["MT2023", "$i", "_", "$a", "$b", ".PDF"]]
    name = F.when(C("doc_id") % 4 == 0, _file(forms[0])).when(C("doc_id") % 4 == 1, _file(forms[1])).when(C("doc_id") % 4 == 2, _file(forms[2])).otherwise(_file(["x/", "$a", " ", "$b", " final.txt"]))
    return df.select("doc_id", name.alias("f"))


@query("name_from_source", f"WITH {_FILES_SQL}, w AS (SELECT doc_id, f, list_filter(string_split({_STEM}, ' '), lambda w: regexp_matches(w, '^\\p{{L}}+$')) AS w FROM f) SELECT doc_id, f AS file, CASE WHEN len(w) >= 2 THEN {_TITLE.format('w[1:4]')} END AS name FROM w")
def name_from_source(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", C("f").alias("file"), X.name_from_file(C("f")).alias("name"))


_WORDS = f"list_transform(string_split({squash_sql('text')}, ' ')[1:14], lambda w: regexp_replace(w, '[^a-zA-Z]', '', 'g'))"


def _window_sql(n: int) -> str:
    ok = " AND ".join(f"length(w[i + {j}]) > 1 AND NOT list_contains({sql_list(V.NAME_STOPS)}, lower(w[i + {j}]))" for j in range(n))
    first = f"list_filter(range(1, 13), lambda i: i <= n - {n} + 1 AND coalesce({ok}, false))[1]"
    return f"CASE WHEN {first} IS NOT NULL THEN {_TITLE.format(f'w[{first} : {first} + {n - 1}]')} END"


_MAIL = r"CASE WHEN regexp_matches(text, '([a-zA-Z]+)[._]([a-zA-Z]+)@') THEN array_to_string(list_transform([regexp_extract(text, '([a-zA-Z]+)[._]([a-zA-Z]+)@', 1), regexp_extract(text, '([a-zA-Z]+)[._]([a-zA-Z]+)@', 2)], lambda w: upper(w[1:1]) || lower(w[2:])), ' ') END"


@query("name_from_text", P + f", q AS (SELECT doc_id, text, {_WORDS} AS w, len(string_split({squash_sql('text')}, ' ')) AS n FROM p) SELECT doc_id, coalesce({_window_sql(3)}, {_window_sql(2)}, {_MAIL}) AS name FROM q")
def name_from_text(spark, sf_dir):
    return profiles(spark, sf_dir).select("doc_id", X.name_from_text(C("text")).alias("name"))


@query("src_dispatch", f"WITH {_FILES_SQL} SELECT doc_id, f AS file, CASE WHEN lower(f) LIKE '%.pdf' THEN 'pdf' WHEN lower(f) LIKE '%.docx' THEN 'docx' ELSE '' END AS kind, lower(f) LIKE '%.pdf' OR lower(f) LIKE '%.docx' AS accepted, regexp_extract(f, '([^/]*)$', 1) AS base FROM f")
def src_dispatch(spark, sf_dir):
    from ..sources.files import accepted, base_name, kind_of

    return files(spark, sf_dir).select("doc_id", C("f").alias("file"), kind_of(C("f")).alias("kind"), accepted(C("f")).alias("accepted"), base_name(C("f")).alias("base"))


_SKILL = "CASE k " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.SYNONYMS.items()) + " ELSE k END"


@query("normalize_skill", f"SELECT s AS skill, {_SKILL} AS normal FROM (SELECT s, lower(trim(s)) AS k FROM (SELECT unnest({sql_list([' ML ', 'ai', 'NLP', 'js', 'Ts', 'py', 'Rust', ''])}) AS s))")
def normalize_skill(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in [" ML ", "ai", "NLP", "js", "Ts", "py", "Rust", ""]], "skill string").withColumn("normal", X.normal_skill(C("skill")))


def degree_sql(x: str) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(lower({x}), {lit(p)})" for p in parts) + f" THEN {lit(g)}" for g, parts in V.DEGREE_GROUPS)
    return f"CASE WHEN coalesce({x}, '') = '' THEN '' {cases} ELSE lower({x}) END"


@query("normalize_degree", P + f"SELECT doc_id, {joined_sql('list_transform(' + DEGREES_SQL + ', lambda d: ' + degree_sql('d') + ')')} AS value FROM p")
def normalize_degree(spark, sf_dir):
    return profiles(spark, sf_dir).select("doc_id", joined(F.transform(X.found_words(F.lower(C("text")), V.DEGREES, whole=True), X.normal_degree)).alias("value"))


@query("text_coalesce", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN lang END, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN source END, ''), nullif(lang, ''), '') AS value FROM documents")
def text_coalesce(spark, sf_dir):
    raw = F.when(C("doc_id") % 3 == 0, "").when(C("doc_id") % 3 == 1, C("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.nullif(raw, F.lit("")), F.nullif(F.when(C("doc_id") % 2 == 0, C("source")), F.lit("")), F.nullif("lang", F.lit("")), F.lit("")).alias("value"))


@query("prefix_context", "SELECT doc_id, concat_ws(' › ', upper(lang), CASE WHEN doc_id % 2 = 0 THEN source || ' (2020-2021)' ELSE source END, coalesce(text, '')) AS value FROM documents")
def prefix_context(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.context_prefix(C("lang"), C("source"), F.when(C("doc_id") % 2 == 0, "2020-2021"), F.coalesce("text", F.lit(""))).alias("value"))


ITEMS = [" Python ", "python", "Web  Development", "SQL", "sql", "", "Cloud Services", "Go", "Rust", "Java", "C"]
_DEDUPE = f"list_filter(list_transform(xs, lambda s: {squash_sql('s')}), lambda s: s <> '')"
_DEDUPED = "list_filter(ys, lambda s, i: list_position(list_transform(ys, lambda z: lower(z)), lower(s)) = i)"
_ITEMS = f"WITH v AS (SELECT doc_id, list_slice({sql_list(ITEMS)}, doc_id % 7 + 1, doc_id % 7 + 1 + doc_id % 6) AS xs FROM documents), y AS (SELECT doc_id, {_DEDUPE} AS ys FROM v), z AS (SELECT doc_id, {_DEDUPED} AS ds FROM y) "


def item_lists(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.slice(X.strings(ITEMS), (C("doc_id") % 7 + 1).cast("int"), (C("doc_id") % 6 + 1).cast("int")).alias("xs"))


@query("dedupe_skills", _ITEMS + f"SELECT doc_id, {joined_sql('ds')} AS value FROM z")
def dedupe_skills(spark, sf_dir):
    return item_lists(spark, sf_dir).select("doc_id", joined(X.deduped(C("xs"))).alias("value"))


@query("display_skills", _ITEMS + f", n AS (SELECT doc_id, ds, list_filter(ds, lambda s: NOT list_contains({sql_list(V.BROAD_SKILLS)}, lower(s))) AS ns FROM z) SELECT doc_id, {joined_sql('(CASE WHEN len(ns) > 0 THEN ns ELSE ds END)[1:3]')} AS value FROM n")
def display_skills(spark, sf_dir):
    return item_lists(spark, sf_dir).select("doc_id", joined(X.display_skills(C("xs"), 3)).alias("value"))


# --- scores ---
_LI = "l AS (SELECT l_orderkey, l_linenumber, (l_quantity / 10)::DOUBLE - 0.5 AS jd, (l_orderkey % 9 - 1)::DOUBLE AS own FROM lineitem)"
_RATIO = "(CASE WHEN own / jd < 1 THEN own / jd ELSE 1 + least(own / jd - 1, 0.2) * 0.5 END)"


def years_pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((C("l_quantity") / 10).cast("double") - 0.5).alias("jd"), (C("l_orderkey") % 9 - 1).cast("double").alias("own"))


def _experience(name, f, sql):
    @query(name, f"WITH {_LI} SELECT l_orderkey, l_linenumber, {sql} AS score FROM l")
    def run(spark, sf_dir):
        return years_pairs(spark, sf_dir).select("l_orderkey", "l_linenumber", f(C("jd"), C("own")).alias("score"))


_experience("experience_score", S.experience, f"CASE WHEN jd <= 0 THEN least(0.5 + own * 0.5, 1) ELSE round(least({_RATIO}, 1), 3) END")
_experience("experience_score_v3", S.experience_capped, f"CASE WHEN jd <= 0 THEN least(0.5 + own * 0.5, 1) ELSE round(least({_RATIO}, 1.2), 3) END")
_experience("experience_score_v2", lambda jd, own: F.round(S.experience_plain(jd, own), 6), "CASE WHEN jd <= 0 THEN 1.0::DOUBLE WHEN own >= jd THEN 1.0::DOUBLE ELSE round(own / jd, 6) END")
_experience("exp_years_v3", lambda jd, own: F.greatest(F.least(F.when(own * 8 == 0, jd).otherwise(own * 8), F.lit(50.0)), F.lit(0.0)), "greatest(least(CASE WHEN own * 8 = 0 THEN jd ELSE own * 8 END, 50.0::DOUBLE), 0.0::DOUBLE)")

JD_EDU = ["Bachelor of Technology"]
_OWN_DEGREES = f"list_transform({DEGREES_SQL}, lambda d: {degree_sql('d')})"


@query("education_score", P + f"SELECT doc_id, CASE WHEN list_contains({_OWN_DEGREES}, 'bachelor') OR len(list_filter({_OWN_DEGREES}, lambda d: contains('bachelor', d) OR contains(d, 'bachelor'))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM p")
def education_score(spark, sf_dir):
    return profiles(spark, sf_dir).select("doc_id", S.education(X.strings(JD_EDU), X.found_words(F.lower(C("text")), V.DEGREES, whole=True)).alias("score"))


@query("education_score_v2", P + f""", e AS (SELECT doc_id, {DEGREES_SQL} AS d, {words_sql('text', V.SCORED_FIELDS)} AS f, round(list_filter({_GRADES}, lambda x: x IS NOT NULL AND x <= 1)[1], 3) AS g FROM p)
SELECT doc_id, round(0.4 * len(list_filter(['bachelor', 'master'], lambda x: list_contains(d, x))) / 2.0 + 0.3 * CASE WHEN list_contains(f, 'computer science') THEN 1 ELSE 0 END + 0.3 * coalesce(g, 0.5), 3)::DOUBLE AS score FROM e""")
def education_score_v2(spark, sf_dir):
    return profiles(spark, sf_dir).select("doc_id", S.education_parts(X.strings(["bachelor", "master"]), X.found_words(F.lower(C("text")), V.DEGREES, whole=True), F.lit("a degree in computer science"), C("text")).alias("score"))


_JD_DOMAINS = ["AI/ML", "Data Engineering", "DevOps"]


@query("context_boost", P + f""", d AS (SELECT doc_id, {domains_sql('text')} AS d, {YEAR} - list_max({_YEARS}) AS age, doc_id % 10 / 10.0 AS base FROM p)
SELECT doc_id, round(least(base + 0.1 * len(list_filter({sql_list(_JD_DOMAINS)}, lambda x: list_contains(d, x))) / 3.0 + 0.1 * CASE WHEN age IS NULL THEN 0 WHEN age <= 1 THEN 1.0 WHEN age <= 2 THEN 0.8 WHEN age <= 4 THEN 0.5 ELSE 0.2 END, 1), 3)::DOUBLE AS score FROM d""")
def context_boost(spark, sf_dir):
    df = profiles(spark, sf_dir)
    return df.select("doc_id", S.context_boost(C("doc_id") % 10 / 10.0, X.strings(_JD_DOMAINS), X.domains(C("text")), C("text"), YEAR).alias("score"))


_OWN = words_sql("lower(text)", SKILLS)
_JDS = ["python", "sql", "docker", "kafka"]
_SETS = P + f", s AS (SELECT doc_id, {_OWN} AS own, {sql_list(_JDS)} AS jd FROM p) "


def skill_sets(spark, sf_dir):
    return profiles(spark, sf_dir).select("doc_id", X.found_words(F.lower("text"), SKILLS).alias("own"), X.strings(_JDS).alias("jd"))


@query("skill_exact", _SETS + "SELECT doc_id, len(list_filter(jd, lambda x: list_contains(own, x))) / 4.0::DOUBLE AS score FROM s")
def skill_exact(spark, sf_dir):
    return skill_sets(spark, sf_dir).select("doc_id", S.exact_share(C("jd"), C("own")).alias("score"))


@query("overlap_ratio", _SETS + "SELECT doc_id, CASE WHEN len(own) = 0 THEN 1.0 ELSE len(list_filter(own, lambda x: list_contains(jd, x)))::DOUBLE / len(own) END AS score FROM s")
def overlap_ratio(spark, sf_dir):
    return skill_sets(spark, sf_dir).select("doc_id", S.overlap(C("own"), C("jd")).alias("score"))


@query("gap_exact", _SETS + f"SELECT doc_id, {joined_sql('list_filter(jd, lambda x: list_contains(own, x))')} AS matched, {joined_sql('list_filter(jd, lambda x: NOT list_contains(own, x))')} AS missing FROM s")
def gap_exact(spark, sf_dir):
    return skill_sets(spark, sf_dir).select("doc_id", joined(F.array_intersect("jd", "own")).alias("matched"), joined(F.array_except("jd", "own")).alias("missing"))


@query("skill_coverage_exact", _SETS + f", w AS (SELECT doc_id, unnest(jd) AS sk, generate_subscripts(jd, 1) AS i, own FROM s) SELECT doc_id, sum(CASE WHEN i <= 2 THEN 2.0 ELSE 1.0 END * CASE WHEN list_contains(own, sk) THEN 1 ELSE 0 END)::DOUBLE / 6.0 AS score, coalesce(string_agg(sk, '|' ORDER BY i) FILTER (NOT list_contains(own, sk)), '') AS missing FROM w GROUP BY doc_id")
def skill_coverage_exact(spark, sf_dir):
    """Weighted coverage by equality alone; here the first two requirements weigh twice."""
    from ..operators.coverage import exact_coverage

    return exact_coverage(skill_sets(spark, sf_dir), "jd", "own", heavy=2).select("doc_id", "score", joined("missing").alias("missing"))


@query("evidence_v1", P + f", s AS (SELECT doc_id, lower(text) AS t, ['python', 'sql', 'machine learning', 'kafka'] AS m FROM p) SELECT doc_id, len(list_filter(m, lambda x: contains(t, x))) / 4.0::DOUBLE AS score FROM s")
def evidence_v1(spark, sf_dir):
    return profiles(spark, sf_dir).select("doc_id", S.evidence_share(X.strings(["Python", "SQL", "ML", "Kafka"]), C("text")).alias("score"))


@query("evidence_nb4", P + f", s AS (SELECT doc_id, {EXPERIENCE_SQL} || ' ' || {PROJECTS_SQL} AS t FROM p) SELECT doc_id, CASE WHEN trim(t) = '' THEN 0.0::DOUBLE ELSE len(list_filter(['python', 'sql', 'spring', 'kafka'], lambda x: contains(t, x))) / 4.0::DOUBLE END AS score FROM s")
def evidence_nb4(spark, sf_dir):
    return profiles(spark, sf_dir).select("doc_id", S.evidence_sections(X.strings(["Python", "SQL", "Spring", "Kafka"]), X.section(C("text"), V.EXPERIENCE_STARTS, V.EXPERIENCE_ENDS), X.section(C("text"), V.PROJECT_STARTS, V.PROJECT_ENDS)).alias("score"))


# --- weights ---
_KEYS = list(V.WEIGHTS)
_RAW = "r AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"((l_orderkey * {i + 3} + l_linenumber * {i + 1}) % 7 - 2)::DOUBLE AS {k}" for i, k in enumerate(_KEYS)) + " FROM lineitem)"


def raw_weights(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[((C("l_orderkey") * (i + 3) + C("l_linenumber") * (i + 1)) % 7 - 2).cast("double").alias(k) for i, k in enumerate(_KEYS)])


_TOTAL = " + ".join(_KEYS)


@query("weights_normalize", f"WITH {_RAW} SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(CASE WHEN {_TOTAL} > 0 THEN {k} / ({_TOTAL}) ELSE {v} END, 9) AS {k}" for k, v in V.WEIGHTS.items()) + " FROM r")
def weights_normalize(spark, sf_dir):
    w = S.normal_weights({k: C(k) for k in _KEYS}, V.WEIGHTS)
    return raw_weights(spark, sf_dir).select("l_orderkey", "l_linenumber", *[F.round(v, 9).alias(k) for k, v in w.items()])


_FLOORED = " + ".join(f"greatest({k}, 0)" for k in _KEYS)


@query("weights_user", f"WITH {_RAW} SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(CASE WHEN {_FLOORED} > 0 THEN greatest({k}, 0) / ({_FLOORED}) ELSE {v} END, 9) AS {k}" for k, v in V.WEIGHTS.items()) + f", ({_TOTAL}) = 100 AS adds_up FROM r")
def weights_user(spark, sf_dir):
    w = S.user_weights({k: C(k) for k in _KEYS})
    return raw_weights(spark, sf_dir).select("l_orderkey", "l_linenumber", *[F.round(v, 9).alias(k) for k, v in w.items()], (sum((C(k) for k in _KEYS), F.lit(0.0)) == 100).alias("adds_up"))


def adaptive_sql(base: dict[str, float]) -> str:
    s, z, e = "CASE WHEN senior THEN 0.10 ELSE 0 END", "years = 0", "edu"
    x = f"({base['experience']} + {s})"
    parts = {k: str(v) for k, v in base.items()}
    parts["required_skills"] += f" + CASE WHEN {z} THEN {x} * 0.5 ELSE 0 END"
    parts["projects"] += f" + CASE WHEN {z} THEN {x} * 0.5 ELSE 0 END"
    parts["experience"] = f"CASE WHEN {z} THEN 0 ELSE {x} END"
    parts["reranker"] += f" + CASE WHEN {e} THEN 0 ELSE {base['education'] / 2} END"
    parts["semantic"] += f" - {s} + CASE WHEN {e} THEN 0 ELSE {base['education'] / 2} END"
    parts["education"] = f"CASE WHEN {e} THEN {base['education']} ELSE 0 END"
    return ", ".join(f"round(({v})::DOUBLE, 9) AS {k}" for k, v in parts.items())


_ASKS = P + f", a AS (SELECT doc_id, contains(lower(text), 'senior') OR contains(lower(text), 'lead') OR contains(lower(text), 'years of experience') AS senior, doc_id % 3 AS years, doc_id % 2 = 0 AS edu, doc_id % 5 = 0 AS pref FROM p) SELECT doc_id, "


def _weights(name, base):
    @query(name, _ASKS + adaptive_sql(base) + " FROM a")
    def run(spark, sf_dir):
        w = S.adaptive(C("text"), C("doc_id") % 3, C("doc_id") % 2 == 0, base)
        return profiles(spark, sf_dir).select("doc_id", *[F.round(v, 9).alias(k) for k, v in w.items()])


_weights("weights_adaptive", V.WEIGHTS)
_weights("weights_rag", V.WEIGHTS_RAG)


@query("weights_nb4", _ASKS + "round((0.32 + CASE WHEN pref THEN 0 ELSE 0.08 END)::DOUBLE, 9) AS required_skills, round((CASE WHEN pref THEN 0.08 ELSE 0 END)::DOUBLE, 9) AS preferred_skills, round((0.16 + CASE WHEN years > 0 THEN 0 ELSE 0.10 END + CASE WHEN edu THEN 0 ELSE 0.06 END)::DOUBLE, 9) AS semantic, round(0.16::DOUBLE, 9) AS reranker, round((CASE WHEN years > 0 THEN 0.10 ELSE 0 END)::DOUBLE, 9) AS experience, round((CASE WHEN edu THEN 0.06 ELSE 0 END)::DOUBLE, 9) AS education, round(0.07::DOUBLE, 9) AS projects, round(0.05::DOUBLE, 9) AS evidence FROM a")
def weights_nb4(spark, sf_dir):
    w = S.adaptive_eight(C("doc_id") % 5 == 0, C("doc_id") % 3 > 0, C("doc_id") % 2 == 0)
    return profiles(spark, sf_dir).select("doc_id", *[F.round(v, 9).alias(k) for k, v in w.items()])


# --- small client-side functions ---
@query("score_band", "SELECT event_id, CASE WHEN value / 100 >= 0.75 THEN 'high' WHEN value / 100 >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM events")
def score_band(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.score_band(C("value") / 100).alias("band"))


@query("verdict_label", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Demonstrated' WHEN 1 THEN 'Claimed only' WHEN 2 THEN 'Absent' ELSE 'Unknown' END AS label FROM events")
def verdict_label(spark, sf_dir):
    v = F.when(C("event_id") % 4 == 0, "demonstrated").when(C("event_id") % 4 == 1, "claimed_only").when(C("event_id") % 4 == 2, "absent").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", S.verdict_label(v).alias("label"))


@query("slice_clamp", "SELECT doc_id, doc_id || ':' || substr(sha256(coalesce(text, '')), 1, 16) AS cache_key, CASE WHEN greatest(doc_id % 50 - 5, 0) < least(doc_id % 400, length(coalesce(text, ''))) THEN substr(coalesce(text, ''), (greatest(doc_id % 50 - 5, 0) + 1)::BIGINT, (least(doc_id % 400, length(coalesce(text, ''))) - greatest(doc_id % 50 - 5, 0))::BIGINT) END AS cut FROM documents")
def slice_clamp(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", C("doc_id").cast("string"), X.content_id(t)).alias("cache_key"), S.slice_clamped(t, (C("doc_id") % 50 - 5).cast("int"), (C("doc_id") % 400).cast("int")).alias("cut"))


@query("verdict_deterministic", "SELECT event_id, CASE WHEN value / 100 > 0.6 THEN 'demonstrated' WHEN value / 100 > 0.3 THEN 'claimed_only' ELSE 'absent' END AS verdict FROM events")
def verdict_deterministic(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.verdict(C("value") / 100).alias("verdict"))


@query("rerank_gate", "SELECT event_id, CASE WHEN s > 0.35 OR k > 0.4 THEN 1 / (1 + exp(-((event_id % 17 - 8)::DOUBLE) / 1.5)) ELSE s * 0.6 END AS score FROM (SELECT event_id, value / 100 AS s, (event_id % 10) / 10.0 AS k FROM events)")
def rerank_gate(spark, sf_dir):
    """The exact scorer sees only the rows that pass the gate: they are split off before it and united after."""
    df = table(spark, sf_dir, "events").select("event_id", (C("value") / 100).alias("s"), (C("event_id") % 10 / 10.0).alias("k"))
    passed = F.coalesce((C("s") > V.GATE_SEMANTIC) | (C("k") > V.GATE_SKILLS), F.lit(False))
    exact = df.where(passed).select("event_id", S.squashed((C("event_id") % 17 - 8).cast("double")).alias("score"))
    return exact.unionByName(df.where(~passed).select("event_id", (C("s") * V.GATE_FACTOR).alias("score")))


@query("extract_validated", f"WITH v AS (SELECT doc_id, doc_id % 7 = 0 AS none, (doc_id % 5) * 3.5 - 3.5 AS years, list_transform(list_filter(list_slice(['  a ', NULL, 'b', ' '], 1, doc_id % 5), lambda s: s IS NOT NULL), lambda s: trim(s)) AS skills FROM documents) SELECT doc_id, CASE WHEN none THEN '' ELSE 'Name ' || doc_id END AS name, CASE WHEN none THEN 0.0 WHEN years > 10 THEN 5.0 WHEN years < 0 THEN 0.0 ELSE years END::DOUBLE AS experience_years, CASE WHEN none THEN '' ELSE {joined_sql('skills')} END AS skills FROM v")
def extract_validated(spark, sf_dir):
    from ..operators.extraction import validated

    none = C("doc_id") % 7 == 0
    exp = F.array(F.struct(F.lit("x").alias("role"), F.lit("full-time").alias("type"), ((C("doc_id") % 5) * 3.5 - 3.5).cast("double").alias("duration_years")))
    skills = F.slice(F.array(F.lit("  a "), F.lit(None), F.lit("b"), F.lit(" ")), F.lit(1), (C("doc_id") % 5).cast("int"))
    raw = F.when(~none, F.struct(F.concat(F.lit(" Name "), C("doc_id"), F.lit(" ")).alias("candidate_name"), skills.alias("skills"), exp.alias("experience"), F.array(F.lit("BSc")).alias("education"), F.array().cast("array<string>").alias("projects"), F.lit("s").alias("semantic_summary")))
    return validated(table(spark, sf_dir, "documents").select("doc_id", raw.alias("extracted")), "extracted").select("doc_id", "name", "experience_years", joined("skills").alias("skills"))


@query("extract_fallback", P + f"SELECT doc_id, {joined_sql(words_sql('lower(text)', V.SKILL_WORDS))} AS skills, coalesce(list_max(list_transform(regexp_extract_all(lower(text), '(\\d+)\\+?\\s*(?:years?|yrs?)(?:\\s+of)?\\s+experience', 1), lambda x: x::INT)), 0)::DOUBLE AS years FROM p")
def extract_fallback(spark, sf_dir):
    from ..operators.extraction import by_rules

    got = by_rules(profiles(spark, sf_dir).select("doc_id", "text"), "text")
    return got.select("doc_id", joined("extracted.skills").alias("skills"), F.aggregate("extracted.experience", F.lit(0.0), lambda s, e: s + e["duration_years"]).alias("years"))


@query("explanation", P + f"SELECT doc_id, 'Candidate ' || doc_id || ' scored ' || printf('%.3f', doc_id % 8 / 8.0) || '. Demonstrates expertise in ' || coalesce(nullif({joined_sql(_OWN).replace(chr(39) + '|' + chr(39), chr(39) + ', ' + chr(39))}, ''), 'relevant skills') || ', aligning with the JD. ' || CASE WHEN doc_id % 3 > 0 THEN 'Has ' || printf('%.1f', (doc_id % 3)::DOUBLE) || ' years of professional experience. ' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'Gaps identified in: kafka.' ELSE 'Closely matches all key required skills.' END AS explanation FROM p")
def explanation(spark, sf_dir):
    from ..operators.ranking import explained

    df = profiles(spark, sf_dir).select("doc_id", F.concat(F.lit("Candidate "), C("doc_id")).alias("name"), (C("doc_id") % 8 / 8.0).alias("final_score"), X.found_words(F.lower("text"), SKILLS).alias("matched"), F.when(C("doc_id") % 2 == 0, X.strings(["kafka"])).otherwise(F.array().cast("array<string>")).alias("missing"), (C("doc_id") % 3).cast("double").alias("years"))
    return df.select("doc_id", explained(C("name"), C("final_score"), C("matched"), C("missing"), C("years")).alias("explanation"))
