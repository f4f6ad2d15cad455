"""Lines of the kinds that the scalar functions tell apart, made from ``orders``, and a query
of each function over them. Columns of numbers and words vary within each kind.

The DuckDB side is written from the rule, in that engine's own syntax.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.plans.registry import register
from folioscope.sources.typeset import read

#: {a}: 1 to 97, {b}: 1 to 9, {y}: a year, {w}: a word of the table in upper case; << and >>
#: stand for braces, \\t for a tab.
KINDS = """
Page {a} of 120|page{a}|Homepage {a}|see Page {a}|{a}|{y}{a}{b}|12345|p. {a}
https://host.org/{a}|at www.host.org now|www.host.org|doi:10.{y}/{a}|doi.org|Copyright {y} {w}|all rights reserved, {w}|© {w}
Please cite this article as {w}|Contents lists available at {w}|Downloaded from {w}|Journal of {w} Vol. {a}, No. {b}|revol. {a}|vol {w}
{w} Letters {y}, {a}–{a}{b}|{w} {y}-0{b}-1{b}|{w} {y}-{a}|in {y} {w} and {a} - {a}{b}|{y}{a} 1{b}-2{b}
* * * *|— — —|____|--|•|= = =|~~~~|-a-|·· ★|..........
• {w} item|· {w}|▸ {w}|◦ {w}|- {w}|* {w}|•{w}|{a}. {w} item|{a}) {w}|{a}.{w}|1234. {w}|{b}.
a. first {w}|b. second {w}|c. third {w}|(i) {w}|(iv) {w} text|ii) {w}|J. {w}|ab. {w}|XIV. {w}|a.{w}|() {w}|vi. {w}
Figure {a}: {w}|Fig. {b}.{b} {w}|FIGURE IV {w}|Figures of {w}|Table ({a}) {w}|Tables (x) {w}|tab {a}|Eq. ({a})|Equation x|Listing {a}|Photograph {a}|Photo {a}|figure  {a}
Source: {w}|Sources: {w}|note: {w}|Noted: {w}|Adapted from {w}|Image source: {w}|Photo credit: {w}|Caption {w}|  Credit: {w}
Contents|CONTENTS:|Table of Contents|Index|index of {w}|List of Figures::|toc
Introduction of {w} ..... {a}|Introduction of {w} {y}{b}|Conclusions {w}{a}|Chapter {a}|Recall of {w} 3 7 94.2|Preface to {w} ... ix|Summary of results {a} {b}|Foreword . . xii|A xi
1|1.{b}|1.{b}.{a}|A.{b}|A{a}|Sec. {b}|Section {b}|§{b}|§|Chapter {b}|Part {b}.|IV|1..2|{b}.
{a}.{b} Scope of {w}|{a}. Scope|{a}.{b}.{a} {w} Details|{a}: {w}|{a}) {w}|Section {a} {w}|Part {w}|Appendix {w}|NZ/AS {a}.{b} {w}|x/as {b} {w}|{a}.x {w}|{w} {a}
0{a}1{b}X {w} WORKS|12{a} Roofing|{y} {w}|{y}AB|{y}ABCDEF {w}|3.1 Timber to NZS {a}|3.2 Fixings to AS {a}|1.5. Decision Theory {a}|{w} theory {y}{a}|{a} {b} {a}|to (ISO) {a}
{a}.{b} . 3|1 2 3|...|A1 Drawing Page {a}|a{b} drawing page|a3 drawing pages|A drawing page|Figure|table {w}|tables {w}|Fig. {w}
{w} AND MORE|{w} and more|É{w} ÀB|{w}|1 2|add {w} to it|Delete {w}|replacement {w}
The {w} shall be:|The {w} shall be|This is a sentence about {w} which is longer than a hundred characters in all, so that it does not read as a heading at all.|One of the long titles, which has commas, and more commas, and goes on about {w} until it has over a hundred and ten signs|{a}.{b} One of the long titles, which has commas, and more commas, and goes on about {w} until it has over a hundred signs
{a} Paint ${b}00|Paint ${b}00|1.{b} @ log|@{w}|x@{w}|see www.host.org {w}|{a}. the {w} will be made by the owner of it|{a}) one two three four five six;|{a}. too short.|{a}
{a}.{b} Scope Of Works.|{a}.{b} Scope of works|{a} SCOPE OF WORKS|{a} Scope of works|{a}.{b} scope
|I|l|1{b}|–|{a}.5%|$ {a}k|{a} 000|abcd|12x{a}|1O|{b}O|O|{a}O|{a}{b}{a}
$448 $427 7%|Revenue {a}|2.{a}|1,{a}|--|—|{y}|± {a}|{a}. {b}
(1)|(12{b})|(a)|(ab)|iv.|a)|AB.|{a}.|●|•–*|⮚|ix|MIX|civil war|vii|mmmmmmm
Note. {w} Next|Note. {w}|one two three four five|a label of {w}|A label that is by far too long to be one {w}
H1|h3|H7|H|P|H 2|h06|Header
architec-|ture|café-|Known|5-|-|co- |Ends here.|Ends “here.”|Ends (here!) |no end|so?
a_b*c|tail {w}_x|<b>{w}</b> & co|x  y\t{w} | z
bcdfghklmnp qrst|strngthwrds ab|vowels are here
סך הכל {a}.{b}|Total due {a} ILS סך|المجموع {a}|12.34|café {w}
#include <x> std::{w}|self.x = {w}; import y|for x in range({a}):|<<"{w}": {a}>>|[{a}, {b}]|def {w}():|if {w}: pass|x -> y
""".strip("\n")
LINES = [kind for row in KINDS.split("\n") for kind in row.split("|")]


def _made(kind: str) -> str:
    """The SQL of one kind, the same in both engines."""
    parts, rest = [], kind
    while rest:
        head, sign, tail = rest.partition("{")
        text = head.replace("<<", "{").replace(">>", "}")
        for k, piece in enumerate(text.split("\\t")):
            parts += ["chr(9)"] * (k > 0) + ([f"'{piece}'"] if piece else [])
        if not sign:
            break
        name, _, rest = tail.partition("}")
        parts.append(name)
    return " || ".join(parts) or "''"


def _case(selector: str) -> str:
    return f"CASE {selector} " + " ".join(f"WHEN {k} THEN {_made(line)}" for k, line in enumerate(LINES)) + " END"


SQL = f"""WITH src AS (SELECT o_orderkey AS id, CAST(o_custkey % 97 + 1 AS STRING) AS a, CAST(o_orderkey % 9 + 1 AS STRING) AS b,
CAST(1950 + o_custkey % 90 AS STRING) AS y, substr(o_orderpriority, 3) AS w, o_custkey % 40 AS n FROM orders),
s AS (SELECT id, n, {_case(f"id % {len(LINES)}")} AS line, {_case(f"(id * 7 + n) % {len(LINES)}")} AS after FROM src)"""


def specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, n, line, after): two lines each; n: 0 to 39."""
    src = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "CAST(o_custkey % 97 + 1 AS STRING) AS a", "CAST(o_orderkey % 9 + 1 AS STRING) AS b",
        "CAST(1950 + o_custkey % 90 AS STRING) AS y", "substr(o_orderpriority, 3) AS w", "o_custkey % 40 AS n",
    )
    plain = [(k, kind.replace("\\t", "\t")) for k, kind in enumerate(LINES)]
    kinds = F.broadcast(spark.createDataFrame(plain, "k long, kind string"))

    def made(rows: DataFrame, selector: str, name: str) -> DataFrame:
        text = F.col("kind")
        for sign in "abyw":
            text = F.replace(text, F.lit("{" + sign + "}"), F.col(sign))
        braces = F.replace(F.replace(text, F.lit("<<"), F.lit("{")), F.lit(">>"), F.lit("}"))
        return rows.join(kinds, F.expr(selector) == F.col("k")).withColumn(name, braces).drop("k", "kind")

    both = made(made(src, f"id % {len(LINES)}", "line"), f"(id * 7 + n) % {len(LINES)}", "after")
    return both.select("id", "n", "line", "after")


# The same rules in DuckDB's words. W: the words of a line.
S_WS = T.WS
TRIM = f"regexp_replace(line, '^{S_WS}+|{S_WS}+$', '', 'g')"
LTRIM = f"regexp_replace(line, '^{S_WS}+', '')"
COLLAPSE = f"trim(regexp_replace(line, '{S_WS}+', ' ', 'g'))"
LEADING = f"list_filter(regexp_split_to_array(line, '{S_WS}+'), lambda x: x <> '')"
YEAR = r"regexp_matches({0}, '(^|[^0-9A-Za-z])(19|20)[0-9]{{2}}([^0-9A-Za-z]|$)')".format(f"lower({TRIM})")
RANGE = f"""len(list_filter(regexp_extract_all({TRIM}, '[0-9]+ *[-–—] *[0-9]+'), lambda x: NOT regexp_full_match(x, '(19|20)[0-9]{{2}} *[-–—] *[0-9]{{1,2}}'))) > 0"""
CHROME = f"""({' OR '.join(f"contains(lower({TRIM}), '{x}')" for x in ('http://', 'https://', ' www.', 'doi:', 'doi.org/', 'please cite this article', 'contents lists available at', 'available online at', 'downloaded from', '©', 'copyright ', 'all rights reserved'))}
 OR starts_with(lower({TRIM}), 'www.') OR regexp_matches(lower({TRIM}), '^page [0-9]') OR regexp_full_match({TRIM}, '[0-9]{{1,4}}')
 OR regexp_matches(lower({TRIM}), '(^|[^0-9a-z])vol[. ,].*[0-9]') OR (octet_length(encode({TRIM})) <= 120 AND {YEAR} AND {RANGE}))"""
N_LETTERS = "length(regexp_replace({0}, '[^\\pL]', '', 'g'))"


def _toc(tail: str, least: int) -> str:
    """Body of a line that ends in a separator with white space and ``tail``; '' of others."""
    return f"regexp_extract({TRIM}, '^(.*[^.{S_WS[1:-1]}])(?:\\.|{S_WS})*{S_WS}(?:\\.|{S_WS})*{tail}$', {least})"


ARABIC = (
    f"CASE WHEN {N_LETTERS.format(_toc('([0-9]{1,4})', 1))} >= 8 AND NOT regexp_matches({_toc('([0-9]{1,4})', 1)}, '[0-9]$')"
    f" THEN {_toc('([0-9]{1,4})', 2)}::INT END"
)
ROMAN = f"{N_LETTERS.format(_toc('([ivxlcdmIVXLCDM]{2,6})', 1))} >= 5"
NUMBER = f"rtrim(CASE WHEN contains({LEADING}[1], '/AS') OR contains({LEADING}[1], '/as') THEN {LEADING}[2] ELSE {LEADING}[1] END, '.):')"
LEVEL = (
    f"CASE WHEN starts_with(lower(line), 'section ') OR starts_with(lower(line), 'part ') OR starts_with(lower(line), 'appendix ') THEN 1"
    f" WHEN regexp_full_match({NUMBER}, '[0-9]+(\\.[0-9]+)*') THEN len(string_split({NUMBER}, '.')) END"
)
SHORT = f"coalesce(regexp_full_match(string_split(rtrim({LEADING}[1], '.):'), '.')[1], '[0-9]{{1,2}}'), false)"
SPEC = f"(len({LEADING}) >= 2 AND regexp_full_match({LEADING}[1], '[0-9]{{4}}[0-9A-Za-z]{{0,4}}'))"
UPPER = f"(len({LEADING}) >= 2 AND regexp_matches(line, '\\pL') AND NOT regexp_matches(line, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]'))"
BULLET_ONLY = f"(regexp_full_match({{0}}, '[{T.BULLET_CELLS}]+') OR regexp_full_match({{0}}, '\\([0-9]{{{{0,3}}}}\\)|\\([A-Za-z]\\)|([0-9]+|[ivxIVX]+|[A-Za-z])[.)]'))"
HYPHEN = f"regexp_matches(line, '\\pL-{S_WS}*$')"
LOWER_NEXT = f"regexp_matches(after, '^{S_WS}*\\p{{Ll}}')"
HAS = lambda signs: " + ".join(f"contains(line, {s})::INT" for s in signs)
PYTHON = [f"'{s}'" for s in ("self.", "import ", "from ", "def ", "class ", "print(", "lambda ", "elif ", "__", " for ", "len(", "sorted(", "range(")] + ["'f' || chr(39)", "'f' || chr(34)"]
MARKER = rf"""CASE WHEN regexp_matches({LTRIM}, '^[{T.BULLETS}]{S_WS}') THEN 'unordered ' || {LTRIM}[1] || ' ' || regexp_replace(regexp_replace({LTRIM}[2:], '^{S_WS}+', ''), '{S_WS}+$', '')
WHEN regexp_matches({LTRIM}, '^[0-9]{{1,3}}[.)]{S_WS}') THEN 'ordered ' || regexp_extract({LTRIM}, '^[0-9]+[.)]') || ' ' || regexp_replace(regexp_replace({LTRIM}, '^[0-9]+[.)]{S_WS}+', ''), '{S_WS}+$', '') END"""
PAREN = rf"^\([^)]+\){S_WS}+."
SUFFIX = rf"^[A-Za-z]{{1,7}}[.)]{S_WS}+."
BODY = f"CASE WHEN regexp_matches({TRIM}, '{PAREN}') THEN regexp_extract({TRIM}, '^\\(([^)]+)\\)', 1) WHEN regexp_matches({TRIM}, '{SUFFIX}') THEN regexp_extract({TRIM}, '^([A-Za-z]+)[.)]', 1) END"
DIGIT_VALUES = "list_transform(range(1, length(r) + 1), lambda k: [1, 5, 10, 50, 100, 500, 1000][strpos('ivxlcdm', r[k])])"
#: A letter is taken off where a larger one stands behind it.
ROMAN_VALUE = "list_sum(list_transform(range(1, len(v) + 1), lambda k: CASE WHEN k < len(v) AND v[k] < list_max(v[k + 1:]) THEN -v[k] ELSE v[k] END))"

def columns() -> dict:
    """The value of each function for a specimen."""
    line, after, pages = F.col("line"), F.col("after"), (F.col("n") * 2).cast("int")
    second, third = F.col("n") % 2 == 0, F.col("n") % 3 == 0
    text = lambda c: F.concat_ws(" ", F.when(c["ordered"], "ordered").otherwise("unordered"), c["marker"], c["rest"])
    return {
        "collapse_whitespace": T.collapse(line),
        "normalize_for_repetition": T.repetition_key(line),
        "normalize_digits": T.digits_as_sign(line),
        "matches_chrome_pattern": T.is_chrome_pattern(line),
        "has_year": T.has_year(F.lower(T.trim(line))),
        "has_digit_range": T.has_digit_range(T.trim(line)),
        "decorative_divider_kind": T.divider_kind(line),
        "parse_list_marker": F.when(T.list_marker(line).isNotNull(), text(T.list_marker(line))),
        "split_ordered_marker": T.ordered_marker(line)["body"],
        "marker_interpretations": F.when(T.ordered_marker(line).isNotNull(), F.array_join(F.transform(T.marker_kinds(T.ordered_marker(line)["body"]), lambda k: F.concat(k["kind"], F.lit(":"), k["value"].cast("string"))), ",")),
        "is_caption_line": T.is_caption(line),
        "is_attribution_line": T.is_attribution(line),
        "is_toc_title": T.is_toc_title(line),
        "toc_entry_arabic_number": T.toc_number(line),
        "looks_like_toc_entry": T.is_toc_entry(line),
        "is_section_number_prefix": T.is_section_number(line),
        "numbered_level": T.numbered_level(line),
        "has_short_numeric_prefix": T.has_short_number(line),
        "is_spec_section_code": T.is_spec_code(line),
        "numbered_level_in_context": T.level_in_context(line, second, third),
        "title_key": T.title_key(line),
        "normalize_repeated_heading": T.collapse(T.digits_as_sign(line)),
        "is_page_number_heading": T.is_page_number_heading(line, pages),
        "is_counter_only_heading": T.is_counter_only(line),
        "is_drawing_page_note": T.is_drawing_note(line),
        "is_caption_heading": T.is_caption_heading(line),
        "is_uppercase_section_title": T.is_uppercase_title(line),
        "is_amendment_instruction_heading": T.is_amendment(line),
        "is_body_sentence_heading": T.is_body_sentence(line),
        "is_priced_schedule_heading": T.is_priced(line),
        "is_log_observation_heading": T.is_log_observation(line),
        "is_contact_heading": T.is_contact(line),
        "is_numbered_list_sentence": T.is_numbered_sentence(line),
        "is_physical_numbered_heading": T.is_physical_heading(line),
        "is_rule_artifact": T.is_rule_artifact(line, F.col("n").cast("double"), F.lit(40.0)),
        "is_chart_label": T.is_chart_label(line),
        "is_margin_line_number_text": T.is_margin_number(line),
        "is_alpha_dominant": T.is_alpha_dominant(line),
        "is_value_like": T.is_value_like(line),
        "is_bullet_only": T.is_bullet_only(line),
        "is_label_like": T.is_label_like(line),
        "is_page_ref": T.is_page_ref(line),
        "looks_like_caption": T.looks_like_caption(line),
        "alpha_ratio": F.round(T.alpha_ratio(line), 6),
        "parse_heading_role": T.heading_role(line),
        "is_rtl_text": T.is_rtl(line),
        "escape_inline": T.escape_inline(line),
        "escape_html_cell": T.escape_html(line),
        "wrap_emphasis": T.emphasis(line, second, third),
        "ends_hyphenated": T.ends_hyphenated(line),
        "ends_sentence_final": T.ends_sentence(line),
        "is_soft_hyphen_break": T.is_soft_break(line, after),
        "dehyphenate_join": T.dehyphenate(line, after),
        "detect_code_language": T.code_language(line),
        "is_likely_garbled": T.is_likely_garbled(line),
        "count_letters_and_vowels": F.concat_ws("/", T.letters(line).cast("string"), T.vowels(line).cast("string")),
    }


#: The same in DuckDB's words.
EXPRESSIONS = {
    "collapse_whitespace": COLLAPSE,
    "normalize_for_repetition": f"regexp_replace(lower({COLLAPSE}), '[0-9]+', '#', 'g')",
    "normalize_digits": "regexp_replace(lower(line), '[0-9]+', '#', 'g')",
    "matches_chrome_pattern": CHROME,
    "has_year": YEAR,
    "has_digit_range": RANGE,
    "decorative_divider_kind": f"CASE WHEN regexp_full_match(regexp_replace(line, '{S_WS}', '', 'g'), '[{T.DIVIDERS}]+') THEN length(regexp_replace(line, '{S_WS}', '', 'g')) >= 3 END",
    "parse_list_marker": MARKER,
    "split_ordered_marker": BODY,
    "marker_interpretations": f"""(SELECT CASE WHEN b IS NULL THEN NULL ELSE array_to_string(list_filter([
          CASE WHEN regexp_full_match(b, '[A-Za-z]') THEN 'alpha-' || c || ':' || (ascii(lower(b)) - 96)::STRING END,
          CASE WHEN c IS NOT NULL AND regexp_full_match(r, '[ivxlcdm]+') AND {ROMAN_VALUE} > 0 THEN 'roman-' || c || ':' || ({ROMAN_VALUE})::INT::STRING END], lambda x: x IS NOT NULL), ',') END
          FROM (SELECT *, {DIGIT_VALUES} AS v FROM (SELECT b, lower(b) AS r, CASE WHEN regexp_full_match(b, '[a-z]+') THEN 'lower' WHEN regexp_full_match(b, '[A-Z]+') THEN 'upper' END AS c FROM (SELECT {BODY} AS b))))""",
    "is_caption_line": f"regexp_matches({LTRIM}, '^(?i:{T.any_of(T.CAPTION_WORDS)})({S_WS}*([0-9]|\\([0-9])|{S_WS}+[IVXLC])')",
    "is_attribution_line": "(" + " OR ".join(f"starts_with(lower({LTRIM}), '{p}')" for p in T.ATTRIBUTIONS) + ")",
    "is_toc_title": f"rtrim(lower({TRIM}), ':') IN ({', '.join(repr(t) for t in T.TOC_TITLES)})",
    "toc_entry_arabic_number": ARABIC,
    "looks_like_toc_entry": f"(({ARABIC}) IS NOT NULL OR {ROMAN})",
    "is_section_number_prefix": f"""(SELECT t <> '' AND (r = '' OR (regexp_matches(r, '[0-9]') AND len(list_filter(string_split(rtrim(r, '.'), '.'), lambda p: NOT regexp_full_match(p, '[A-Z][0-9]*|[0-9]+'))) = 0 AND NOT ends_with(r, '..')))
        FROM (SELECT t, CASE WHEN starts_with(t, '§') THEN t[2:] ELSE regexp_replace(t, '^(Sec\\.|Sec|Ch\\.|Ch|Chapter|Chap\\.|Chap|Part){S_WS}*', '') END AS r FROM (SELECT {TRIM} AS t)))""",
    "numbered_level": LEVEL,
    "has_short_numeric_prefix": SHORT,
    "is_spec_section_code": SPEC,
    "numbered_level_in_context": f"CASE WHEN n % 2 = 0 AND {SPEC} THEN 1 WHEN n % 3 = 0 AND NOT {SPEC} AND {SHORT} THEN (CASE WHEN ({LEVEL}) IS NOT NULL THEN least(({LEVEL}) + 1, 6) END) ELSE {LEVEL} END",
    "title_key": f"trim(regexp_replace(lower(regexp_replace(line, '[^\\pL\\pN{S_WS[1:-1]}]', '', 'g')), '{S_WS}+', ' ', 'g'))",
    "normalize_repeated_heading": f"trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '{S_WS}+', ' ', 'g'))",
    "is_page_number_heading": f"""(SELECT coalesce(len(w) >= 3 AND regexp_full_match(w[-1], '[0-9]{{1,9}}') AND try_cast(w[-1] AS INT) > 0 AND (n = 0 OR try_cast(w[-1] AS INT) <= n * 2)
        AND len(list_filter(w[:-2], lambda x: regexp_matches(x, '\\pL'))) > 0
        AND upper(regexp_replace(w[-2], '^[^\\pL\\pN]+|[^\\pL\\pN]+$', '', 'g')) NOT IN ('NZS', 'AS', 'BS', 'ISO', 'EN', 'AS/NZS', 'BS/EN'), false) FROM (SELECT {LEADING} AS w))""",
    "is_counter_only_heading": "(regexp_full_match(line, '[0-9. ]+') AND regexp_matches(line, '[0-9]'))",
    "is_drawing_page_note": f"coalesce(regexp_full_match(lower({LEADING}[1]), 'a[0-9]+') AND lower({LEADING}[2]) = 'drawing' AND lower({LEADING}[3]) = 'page', false)",
    "is_caption_heading": f"(lower({TRIM}) IN ('figure', 'table') OR starts_with(lower({TRIM}), 'figure ') OR starts_with(lower({TRIM}), 'table ') OR starts_with(lower({TRIM}), 'fig. '))",
    "is_uppercase_section_title": UPPER,
    "is_amendment_instruction_heading": "(starts_with(lower(line), 'add ') OR starts_with(lower(line), 'delete ') OR starts_with(lower(line), 'replace '))",
    "is_body_sentence_heading": f"""((octet_length(encode(line)) >= 100 AND ends_with(rtrim(line), '.')) OR (starts_with(lower(line), 'the ') AND contains(lower(line), ' shall ') AND ends_with(line, ':'))
        OR (octet_length(encode(line)) >= 110 AND length(line) - length(replace(line, ',', '')) >= 2 AND ({LEVEL}) IS NULL))""",
    "is_priced_schedule_heading": f"(({LEVEL}) IS NOT NULL AND contains(line, '$'))",
    "is_log_observation_heading": "starts_with(ltrim(line, '0123456789. '), '@')",
    "is_contact_heading": "(contains(lower(line), 'www.') OR contains(lower(line), 'http://') OR contains(lower(line), 'https://'))",
    "is_numbered_list_sentence": f"""coalesce(regexp_full_match(rtrim({LEADING}[1], '.)'), '[0-9]+') AND (len({LEADING}) = 1 OR (len({LEADING}) >= 7
        AND (right(line, 1) IN ('.', ';', ':') OR contains(lower(line), ' will ') OR contains(lower(line), ' shall ')))), false)""",
    "is_physical_numbered_heading": f"""coalesce(len({LEADING}) BETWEEN 2 AND 12 AND regexp_matches({LEADING}[1], '^[0-9]') AND ({LEVEL}) IS NOT NULL AND (contains({LEADING}[1], '.') OR {UPPER})
        AND octet_length(encode(line)) <= 100 AND NOT ends_with(line, '.') AND regexp_matches({LEADING}[2], '^\\p{{Lu}}'), false)""",
    "is_rule_artifact": f"(NOT regexp_matches(line, '[\\pL\\pN]') OR ({TRIM} IN ('|', 'I', 'l', '1', '!', 'i', 'j', '[', ']', '(', ')', '{{', '}}', '/', chr(92)) AND n < 14))",
    "is_chart_label": f"(length({TRIM}) <= 3 OR (regexp_matches(line, '[0-9]') AND regexp_full_match({TRIM}, '[-0-9,.%+$€£ kKMx]+')))",
    "is_margin_line_number_text": f"regexp_full_match({TRIM}, '[0-9]{{1,2}}O?')",
    "is_alpha_dominant": "(length(regexp_replace(line, '[^\\pL]', '', 'g')) > length(regexp_replace(line, '[^0-9]', '', 'g')))",
    "is_value_like": f"(regexp_full_match({TRIM}, '[-–—]+') OR contains(line, '$') OR contains(line, '%') OR contains(line, '±') OR regexp_matches(line, '[0-9][.,][0-9]'))",
    "is_bullet_only": BULLET_ONLY.format(TRIM),
    "is_label_like": f"({TRIM} <> '' AND length({TRIM}) <= 40 AND NOT {BULLET_ONLY.format(TRIM)} AND len({LEADING}) <= 4 AND NOT regexp_matches(line, '\\. [A-Z]'))",
    "is_page_ref": f"(regexp_full_match({TRIM}, '[0-9]+') OR regexp_full_match(lower({TRIM}), '[ivxlcdm]{{1,6}}'))",
    "looks_like_caption": f"regexp_matches(lower({LTRIM}), '^(figure|fig\\.|fig|table|tab\\.|tab) [0-9]')",
    "alpha_ratio": f"CASE WHEN length(regexp_replace(line, '{S_WS}', '', 'g')) > 0 THEN round(length(regexp_replace(line, '[^\\pL]', '', 'g'))::DOUBLE / length(regexp_replace(line, '{S_WS}', '', 'g')), 6) ELSE 0.0::DOUBLE END",
    "parse_heading_role": f"CASE WHEN regexp_full_match({TRIM}, '[Hh]0*[1-6]') THEN right({TRIM}, 1)::INT END",
    "is_rtl_text": f"(length(regexp_replace(line, '[^{T.RTL[1:-1]}]', '', 'g')) > length(regexp_replace(regexp_replace(line, '{T.RTL}', '', 'g'), '[^\\pL]', '', 'g')))",
    "escape_inline": "replace(replace(replace(line, chr(92), chr(92) || chr(92)), '*', chr(92) || '*'), '_', chr(92) || '_')",
    "escape_html_cell": "replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), ' ')",
    "wrap_emphasis": f"CASE WHEN {TRIM} = '' THEN line ELSE repeat('*', CASE WHEN n % 6 = 0 THEN 3 WHEN n % 2 = 0 THEN 2 WHEN n % 3 = 0 THEN 1 ELSE 0 END) || line || repeat('*', CASE WHEN n % 6 = 0 THEN 3 WHEN n % 2 = 0 THEN 2 WHEN n % 3 = 0 THEN 1 ELSE 0 END) END",
    "ends_hyphenated": HYPHEN,
    "ends_sentence_final": "right(rtrim(rtrim(line), '\")]»”’' || chr(39)), 1) IN ('.', '!', '?')",
    "is_soft_hyphen_break": f"({HYPHEN} AND {LOWER_NEXT})",
    "dehyphenate_join": f"CASE WHEN after = '' THEN line WHEN line = '' THEN after WHEN {HYPHEN} AND {LOWER_NEXT} THEN rtrim(line)[:-2] || regexp_replace(after, '^{S_WS}+', '') ELSE line || ' ' || after END",
    "detect_code_language": f"""CASE WHEN regexp_matches(line, '^{S_WS}*[{{\\[]') AND contains(line, '":') THEN 'json' WHEN {HAS([f"'{s}'" for s in ('#include', 'std::', 'int main', 'nullptr', '->', '::', 'template<')])} >= 2 THEN 'cpp'
        WHEN {HAS(PYTHON)} >= 2 OR ({HAS(PYTHON)} >= 1 AND regexp_matches({TRIM}, '^(if |for |while |def |class |elif |else|try|except|with ).*:$')) THEN 'python' END""",
    "is_likely_garbled": "(length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 10 AND length(regexp_replace(line, '[^AEIOUaeiou]', '', 'g')) * 10 < length(regexp_replace(line, '[^A-Za-z]', '', 'g')))",
    "count_letters_and_vowels": "length(regexp_replace(line, '[^A-Za-z]', '', 'g'))::STRING || '/' || length(regexp_replace(line, '[^AEIOUaeiou]', '', 'g'))::STRING",
}


for _name, _expression in EXPRESSIONS.items():
    register(
        _name, lambda spark, sf_dir, name=_name: specimens(spark, sf_dir).select("id", columns()[name].alias("value")),
        f"{SQL} SELECT id, {_expression} AS value FROM s",
    )
