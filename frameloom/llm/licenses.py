"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory above.

A file's units are its lines that mention a licence (CUE), and its blocks of several lines that do: what stands between blank lines,
comment marks aside, so that a wrapped header is compared whole and a licence file by its title and its paragraphs. Units become
sparse vectors of (1 + ln tf) * idf, idf taken over the templates and largest for words that none of them has; version numbers weigh
VERSION_WEIGHT times as much. The cosine to each template is a join on the words. A template counts only where the unit has all of its
version numbers and all words that name a licence (NAMES), and none of the words that make another licence of it (MODIFIERS) but its own. A short
statement that a file is under a licence may say more than the template: a template whose words it has all counts at THRESHOLD at least.
The best template at THRESHOLD or above is the file's own licence; of equal scores that of the licence with more units, then the first by name.

A line with an SPDX tag is no unit. It is read as an expression, of known identifiers joined by AND, OR and WITH; the first that is understood
is the file's licence, at a score of 1. A tag with an identifier that is not known says that there is another licence: such a file has none that
we know (origin `unknown`), and inherits none.

Licence files also speak for their directory: a file without a licence of its own takes that of the deepest directory above it
that has one. Only DataFrame operations are used; templates and their words are a fixed, small table.

Defined results: a null or empty text has no licence of its own and may inherit; a null path inherits nothing; a line that reserves all
rights counts only beside no other licence; several licence files of a directory go to the best score, then the first path; rows that
repeat a path are scanned one by one; empty tables give empty results; further columns pass through `keep`.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_dimension, materialize
from .license_texts import MODIFIERS, NAMES, RESERVED_LINE, RESERVED_NAME, SPDX_IDS, TEMPLATES

#: WHOLE: squared weights of a template's words, which add up to 1, from which a unit has all of them.
THRESHOLD, VERSION_WEIGHT, WHOLE = 0.7, 3, 0.999999
CUE = r"(?i)licen[sc]e|copyright|permission|permitted|redistribut|warrant|spdx|cc0|unencumbered|endorse"
#: Reserves all rights, and does not license anything: counts where a file has no other licence, and is not replaced by an inherited one.
RESERVED = r"(?i)\ball\s+rights\s+(are\s+)?reserved\b"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"
#: A line that is blank but for comment marks, between two blocks; a word or version number; what a number says no more for.
#: What an SPDX tag begins with, in small letters, what it says, and the tokens of that.
MARK, TAG, TOKENS = "spdx-license-identifier:", r"(?i)SPDX-License-Identifier:[ \t]*([^\n\r*#<>;]*)", r"[A-Za-z0-9][A-Za-z0-9.+:-]*|[()]"
#: An expression by the kinds of its tokens: i an identifier, w WITH, o AND or OR.
SHAPE = r"^\(*i(wi)?\)*(o\(*i(wi)?\)*)*$"
#: A line that says what a file is under, and the most words of it.
STATEMENT, MOST_WORDS = r"(?i)\b(licen[sc]ed|released|distributed|available|covered|governed|provided)\b[^\n]*\b(under|by)\b", 60
BLANK, WORDS, ZEROS = r"\n[ \t\r#*/;%!-]*\n", r"[a-z]+|[0-9]+(?:\.[0-9]+)*", r"(\.0+)+$"


def words_of(text: str) -> list[str]:
    return [re.sub(ZEROS, "", w) for w in re.findall(WORDS, text.lower())]


def _weight(word: str, n: int, idf: float) -> float:
    return (1 + math.log(n)) * idf * (VERSION_WEIGHT if word[0].isdigit() else 1)


def compared() -> list[tuple[str, Counter]]:
    """Licence and words of the templates that units are compared with."""
    return [(name, Counter(words_of(t))) for name, ts in sorted(TEMPLATES.items()) for t in ts if not re.search(TAG, t)]


def binding(word: str) -> bool:
    """Whether a unit must have a template's word."""
    return word[0].isdigit() or word in NAMES


def template_table() -> tuple[list[tuple[str, int, str, float, int]], dict[str, float], float]:
    """((licence, template, word, weight of the unit vector, its binding words), ...), idf of each word, and the idf of any other."""
    texts = compared()
    seen: dict[str, int] = defaultdict(int)
    for _, words in texts:
        for w in words:
            seen[w] += 1
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in seen.items()}
    rows = []
    for number, (name, words) in enumerate(texts):
        weight = {w: _weight(w, n, idf[w]) for w, n in words.items()}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        rows += [(name, number, w, x / norm, sum(map(binding, words))) for w, x in sorted(weight.items())]
    return rows, idf, math.log(1 + len(texts)) + 1


def _tagged(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit(MARK))


def untagged(text: Column) -> Column:
    """The text with its lines that hold an SPDX tag empty."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(_tagged(x), "").otherwise(x))
    return F.when(_tagged(text), F.array_join(lines, "\n")).otherwise(text)


def units(text: Column) -> Column:
    """A text's lines and blocks of several lines that mention a licence, SPDX tags aside, and a line of its own if it reserves all rights."""
    cued = lambda parts: F.filter(parts, lambda x: x.rlike(CUE))
    rest = untagged(text)
    lines, blocks = cued(F.split(rest, "\n")), F.filter(cued(F.split(rest, BLANK)), lambda x: F.contains(x, F.lit("\n")))
    reserved = F.when(text.rlike(RESERVED), F.array(F.lit(RESERVED_LINE))).otherwise(F.array().cast("array<string>"))
    return F.concat(lines, blocks, reserved)


def expressions(text: Column) -> Column:
    """What a text's SPDX tags say, one by one: the expression in our names, or null where it is not understood; an empty array without tags."""
    names = F.create_map(*[F.lit(x) for pair in sorted(SPDX_IDS.items()) for x in pair])

    def read(tag: Column) -> Column:
        tokens = F.regexp_extract_all(tag, F.lit(TOKENS), F.lit(0))
        before = lambda i: F.upper(F.coalesce(F.get(tokens, i - 1), F.lit("")))
        joint = lambda t: F.upper(t).isin("AND", "OR", "WITH")
        kind = lambda t: F.when(F.upper(t) == "WITH", "w").when(joint(t), "o").when(t.isin("(", ")"), t).otherwise("i")
        name = lambda t, i: F.when(joint(t), F.upper(t)).when(t.isin("(", ")") | (before(i) == "WITH"), t).otherwise(F.try_element_at(names, F.lower(t)))
        said = F.transform(tokens, name)
        sound = F.array_join(F.transform(tokens, kind), "").rlike(SHAPE) & ~F.exists(said, lambda x: x.isNull())
        sound &= F.size(F.filter(tokens, lambda t: t == "(")) == F.size(F.filter(tokens, lambda t: t == ")"))
        return F.when(sound, F.replace(F.replace(F.array_join(said, " "), F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")")))

    found = F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), read)
    return F.when(_tagged(text), found).otherwise(F.array().cast("array<string>"))


def _own(files: DataFrame, threshold: float) -> DataFrame:
    """(file, license, score) of files (file, units) that have a licence of their own."""
    rows, idf, other = template_table()
    spark: SparkSession = files.sparkSession
    templates = spark.createDataFrame(rows, "license string, template int, word string, weight double, musts int")
    idfs = spark.createDataFrame(sorted(idf.items()), "word string, idf double")
    found = F.transform(F.regexp_extract_all(F.lower("line"), F.lit(WORDS), F.lit(0)), lambda w: F.regexp_replace(w, ZEROS, ""))
    one = files.select("file", F.posexplode("units").alias("unit", "line")).withColumn("words", found)
    states = F.col("line").rlike(STATEMENT) & (F.size("words") <= MOST_WORDS)
    #: Before the words are parted, for it is a line's and not a word's.
    one = one.select("file", "unit", states.alias("states"), "words")
    words = one.select("file", "unit", "states", F.explode("words").alias("word"))
    counted = words.groupBy("file", "unit", "word").agg(F.count("*").alias("n"), F.first("states").alias("states"))
    number, must, other_kind = F.col("word").rlike("^[0-9]"), F.col("word").rlike("^[0-9]") | F.col("word").isin(*NAMES), F.col("word").isin(*MODIFIERS)
    weight = (1 + F.log("n")) * F.coalesce("idf", F.lit(other)) * F.when(number, VERSION_WEIGHT).otherwise(1)
    weighed = materialize(counted.join(F.broadcast(idfs), "word", "left").select("file", "unit", "states", "word", weight.alias("w")), "license-words")
    norms = weighed.groupBy("file", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.first("states").alias("states"), F.count_if(other_kind).alias("kinds"))
    dots = weighed.join(F.broadcast(templates), "word").groupBy("file", "unit", "license", "template").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot"), F.sum(F.col("weight") * F.col("weight")).alias("held"), F.count_if(must).alias("met"), F.max("musts").alias("musts"), F.count_if(other_kind).alias("own_kinds")
    )
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    whole = F.col("states") & (F.col("held") > WHOLE)
    scored = dots.filter("met = musts").join(norms, ["file", "unit"]).filter("kinds = own_kinds")
    scored = scored.withColumn("score", F.when(whole, F.greatest(cosine, F.lit(float(threshold)))).otherwise(cosine)).filter(F.col("score") >= threshold)
    per = scored.groupBy("file", "license").agg(F.max("score").alias("score"), F.countDistinct("unit").alias("units"))
    order = F.struct((F.col("license") == RESERVED_NAME).alias("reserved"), (-F.col("score")).alias("less"), (-F.col("units")).alias("fewer"), "license")
    best = materialize(per.groupBy("file").agg(F.min(order).alias("best")), "licenses")
    discard(weighed)
    return best.select("file", F.col("best.license").alias("license"), (-F.col("best.less")).alias("score"))


def scan_licenses(files: DataFrame, path: Column, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """For files with a text column: the columns of keep, path, license, score, origin (own, inherited) and directory it comes from."""
    keep = keep or []
    source = files.select(path.alias("path"), "text", *[F.col(c).alias(f"keep_{c}") for c in keep])
    #: A licence is looked for in the units only; so texts are read once and shuffled nowhere.
    rows = source.select(F.monotonically_increasing_id().alias("file"), "path", units(F.col("text")).alias("units"), expressions(F.col("text")).alias("tags"), *[f"keep_{c}" for c in keep])
    rows = materialize(rows, "license-files")
    own = _own(rows.filter(F.size("tags") == 0), threshold)
    said = F.get(F.array_compact("tags"), F.lit(0))
    named = rows.drop("units").join(own, "file", "left").withColumns({"license": F.coalesce(said, "license"), "score": F.when(said.isNotNull(), 1.0).otherwise(F.col("score")), "unknown": (F.size("tags") > 0) & said.isNull()}).drop("tags")
    folder = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    first = F.min(F.struct((F.col("license") == RESERVED_NAME).alias("reserved"), (-F.col("score")).alias("less"), "path", "license"))
    folders = named.filter(F.col("path").rlike(LICENSE_FILE) & F.col("license").isNotNull()).groupBy(folder(F.col("path")).alias("directory")).agg(first.alias("best"))
    folders = materialize(folders.select("directory", F.col("best.license").alias("theirs"), (-F.col("best.less")).alias("their_score")), "license-folders")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    open_ = named.filter("license is null and path is not null and not unknown").select("file", F.posexplode(above).alias("depth", "directory"))
    found = join_dimension(open_, folders, "directory", folders.count(), F.col("file")).filter("theirs is not null")
    nearest = found.groupBy("file").agg(F.max(F.struct("depth", "directory", "theirs", "their_score")).alias("near"))
    joined = named.join(nearest, "file", "left")
    mine = F.col("license").isNotNull()
    return joined.select(
        *[F.col(f"keep_{c}").alias(c) for c in keep], "path", F.coalesce("license", "near.theirs").alias("license"), F.coalesce("score", "near.their_score").alias("score"),
        F.when(mine, "own").when(F.col("unknown"), "unknown").when(F.col("near").isNotNull(), "inherited").alias("origin"), F.when(mine, F.lit(None)).otherwise(F.col("near.directory")).alias("directory"),
    )


def _op5_sql() -> str:
    """The query op5_license_scan in DuckDB's SQL, templates and their weights as values. Tags are single identifiers in the given tables; others are not understood here."""
    rows, idf, other = template_table()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda words: ", ".join(map(quoted, sorted(words)))
    number, must, kind = "regexp_matches({}, '^[0-9]')", "(regexp_matches({}, '^[0-9]') OR {} IN (" + listed(NAMES) + "))", "({} IN (" + listed(MODIFIERS) + "))"
    cue = f"regexp_matches(coalesce(text, ''), '{CUE}')"
    return f"""WITH tpl(license, template, word, weight, musts) AS (VALUES {", ".join(f"({quoted(a)}, {b}, {quoted(c)}, {d!r}::DOUBLE, {e})" for a, b, c, d, e in rows)}),
 idfs(word, idf) AS (VALUES {", ".join(f"({quoted(w)}, {x!r}::DOUBLE)" for w, x in sorted(idf.items()))}), ids(id, name) AS (VALUES {", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in sorted(SPDX_IDS.items()))}),
 f AS (SELECT doc_id, text, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN contains(lower(x), '{MARK}') THEN '' ELSE x END), chr(10)) AS rest, coalesce(source, 'unknown') || CASE WHEN {cue} AND doc_id % 6 = 0 THEN '' ELSE '/' || (doc_id // 50) END || '/' || CASE WHEN {cue} AND doc_id % 2 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS path FROM documents),
 tags AS (SELECT doc_id, name, nth FROM (SELECT doc_id, unnest(t) AS tag, generate_subscripts(t, 1) AS nth FROM (SELECT doc_id, regexp_extract_all(text, '{TAG}', 1) AS t FROM f WHERE text IS NOT NULL) a) b LEFT JOIN ids ON id = lower(trim(tag))),
 tagged AS (SELECT doc_id, arg_min(name, nth) FILTER (WHERE name IS NOT NULL) AS said FROM tags GROUP BY 1),
 parts AS (SELECT doc_id, list_concat(list_filter(string_split(rest, chr(10)), lambda x: regexp_matches(x, '{CUE}')), list_filter(string_split_regex(rest, '{BLANK}'), lambda x: regexp_matches(x, '{CUE}') AND contains(x, chr(10))),
  CASE WHEN regexp_matches(text, '{RESERVED}') THEN ['{RESERVED_LINE}'] ELSE [] END) AS u FROM f WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM tagged)),
 un AS (SELECT doc_id, unnest(u) AS line, generate_subscripts(u, 1) AS unit FROM parts WHERE len(u) > 0),
 ws AS (SELECT doc_id, unit, regexp_extract_all(lower(line), '{WORDS}') AS words, regexp_matches(line, '{STATEMENT}') AND len(regexp_extract_all(lower(line), '{WORDS}')) <= {MOST_WORDS} AS states FROM un),
 w AS (SELECT doc_id, unit, states, regexp_replace(unnest(words), '{ZEROS}', '') AS word FROM ws),
 n AS (SELECT doc_id, unit, states, word, count(*) AS n FROM w GROUP BY ALL),
 g AS (SELECT doc_id, unit, states, n.word, (1 + ln(n)) * coalesce(idf, {other!r}::DOUBLE) * CASE WHEN {number.format("n.word")} THEN {VERSION_WEIGHT} ELSE 1 END AS w FROM n LEFT JOIN idfs ON idfs.word = n.word),
 norms AS (SELECT doc_id, unit, states, sqrt(sum(w * w)) AS norm, count(*) FILTER (WHERE {kind.format("word")}) AS kinds FROM g GROUP BY ALL),
 dots AS (SELECT doc_id, unit, license, template, sum(w * weight) AS dot, sum(weight * weight) AS held, count(*) FILTER (WHERE {kind.format("g.word")}) AS own_kinds FROM g JOIN tpl ON tpl.word = g.word GROUP BY ALL
  HAVING count(*) FILTER (WHERE {must.format("g.word", "g.word")}) = max(musts)),
 sc AS (SELECT doc_id, license, unit, CASE WHEN states AND held > {WHOLE} THEN greatest(round(dot / norm, 6), {THRESHOLD}) ELSE round(dot / norm, 6) END AS score FROM dots JOIN norms USING (doc_id, unit) WHERE kinds = own_kinds),
 per AS (SELECT doc_id, license, max(score) AS score, count(DISTINCT unit) AS units FROM sc WHERE score >= {THRESHOLD} GROUP BY ALL),
 own AS (SELECT doc_id, license, score FROM per QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY license = '{RESERVED_NAME}', score DESC, units DESC, license) = 1 UNION ALL SELECT doc_id, said, 1.0 FROM tagged WHERE said IS NOT NULL),
 named AS (SELECT f.doc_id, path, license, score, t.doc_id IS NOT NULL AND said IS NULL AS unknown, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d1, regexp_extract(regexp_extract(path, '^(.*)/[^/]*$', 1), '^(.*)/[^/]*$', 1) AS d2 FROM f LEFT JOIN own ON own.doc_id = f.doc_id LEFT JOIN tagged t ON t.doc_id = f.doc_id),
 folders AS (SELECT d1 AS directory, license AS theirs, score AS their_score FROM named WHERE regexp_matches(path, '{LICENSE_FILE}') AND license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d1 ORDER BY license = '{RESERVED_NAME}', score DESC, path, license) = 1)
SELECT doc_id, path, coalesce(license, a.theirs, b.theirs) AS license, coalesce(score, a.their_score, b.their_score) AS score,
 CASE WHEN license IS NOT NULL THEN 'own' WHEN unknown THEN 'unknown' WHEN coalesce(a.theirs, b.theirs) IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN license IS NULL THEN coalesce(a.directory, b.directory) END AS directory
FROM named LEFT JOIN folders a ON a.directory = d1 AND NOT unknown LEFT JOIN folders b ON b.directory = d2 AND d2 <> '' AND NOT unknown"""


OP5_SQL = _op5_sql()
