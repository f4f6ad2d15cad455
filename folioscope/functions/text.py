"""Scalar functions on lines of text, as Column expressions inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are white space, bullets, dividers, closing signs.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BULLETS = "•·◦▪▸▶●○■□\uf0b7"
DIVIDERS = "*_–—•·●▪■◦★☆-"
BULLET_CELLS = "•●○◦▪■□‣⁃*–—⮚►▶\uf0b7-"
CLOSERS = "\"')\\]»”’"
#: Ends after which a paragraph doesn't go on in the next column.
STOPS = ".!?:;”\")\\]。』」"
# Words that begin a caption, an attribution, the titles of a table of contents,
# bodies that issue standards, leads of a section number.
CAPTION_WORDS = "figures figure fig. fig tables table tab. tab equation eq. eq scheme chart plate photo algorithm listing".split()
ATTRIBUTIONS = (
    "source: sources: note: notes: image: photo: credit: caption:".split()
    + ["adapted from", "reproduced from", "reprinted from", "image source:", "photo credit:"]
)
TOC_TITLES = ["contents", "table of contents", "table of content", "index", "list of figures", "list of tables", "table of figures", "toc"]
STANDARDS = ["NZS", "AS", "BS", "ISO", "EN", "AS/NZS", "BS/EN"]
SECTION_LEADS = ["Sec.", "Sec", "Ch.", "Ch", "Chapter", "Chap.", "Chap", "Part"]
CHROME = (
    r"https?://|^www\.| www\.|doi:|doi\.org/|please cite this article|contents lists available at"
    r"|available online at|downloaded from|©|copyright |all rights reserved|^page [0-9]|^[0-9]{1,4}$"
)
RTL = r"[\x{590}-\x{7BF}\x{800}-\x{85F}\x{8A0}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}\x{10800}-\x{10FFF}\x{1E800}-\x{1EFFF}]"


def any_of(words: list[str]) -> str:
    """A pattern of the words as they are."""
    return "|".join(w.replace(".", r"\.") for w in words)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def words(c: Column) -> Column:
    """The words between white space; none of a blank line."""
    return F.filter(F.split(c, f"{WS}+", -1), lambda w: w != "")


def kept(c: Column, pattern: str) -> Column:
    """How many characters match the class ``pattern``."""
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def digits_as_sign(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[0-9]+", "#")


def repetition_key(c: Column) -> Column:
    """Lower case, collapsed, digit runs as #: what makes two running lines the same."""
    return digits_as_sign(collapse(c))


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^A-Za-z]", ""))


def vowels(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^AEIOUaeiou]", ""))


def is_likely_garbled(c: Column) -> Column:
    return (letters(c) >= 10) & (vowels(c) * 10 < letters(c))


def has_year(c: Column) -> Column:
    """A year of the last or this century that stands alone."""
    return c.rlike("(?<![0-9A-Za-z])(?:19|20)[0-9]{2}(?![0-9A-Za-z])")


def has_digit_range(c: Column) -> Column:
    """Two numbers with a dash between, other than a year and its month."""
    found = F.regexp_extract_all(c, F.lit("[0-9]+ *[-–—] *[0-9]+"), F.lit(0))
    return F.exists(found, lambda r: ~r.rlike("^(?:19|20)[0-9]{2} *[-–—] *[0-9]{1,2}$"))


def is_chrome_pattern(c: Column) -> Column:
    """Whether a line alone looks like a running header or footer."""
    t = trim(c)
    low = F.lower(t)
    volume = low.rlike("(?<![0-9a-z])vol[. ,].*[0-9]")
    cited = (F.octet_length(t) <= 120) & has_year(low) & has_digit_range(t)
    return low.rlike(CHROME) | volume | cited


def divider_kind(c: Column) -> Column:
    """True for a rule of three signs or more, false for one or two, null for anything else."""
    bare = F.regexp_replace(c, WS, "")
    return F.when(bare.rlike(f"^[{DIVIDERS}]+$"), F.length(bare) >= 3)


def is_divider(c: Column) -> Column:
    return F.coalesce(divider_kind(c), F.lit(False))


def list_marker(c: Column) -> Column:
    """(ordered, marker, rest), or null. Hyphens and asterisks aren't bullets."""
    t = trim(c)
    bullet, number = f"^([{BULLETS}]){WS}+(.*)$", rf"^([0-9]{{1,3}}[.)]){WS}+(.*)$"
    # A marker needs white space behind it, of which a trimmed line may have lost all.
    full = F.regexp_replace(c, f"^{WS}+", "")
    bare = f"^([{BULLETS}]){WS}+$", rf"^([0-9]{{1,3}}[.)]){WS}+$"
    held = lambda ordered, pattern, of: F.struct(
        F.lit(ordered).alias("ordered"), F.regexp_extract(of, pattern, 1).alias("marker"),
        (F.regexp_extract(of, pattern, 2) if "(.*)" in pattern else F.lit("")).alias("rest"),
    )
    return (
        F.when(t.rlike(bullet), held(False, bullet, t)).when(t.rlike(number), held(True, number, t))
        .when(full.rlike(bare[0]), held(False, bare[0], full)).when(full.rlike(bare[1]), held(True, bare[1], full))
    )


def ordered_marker(c: Column) -> Column:
    """(body, marker, rest) of a lettered or roman marker with text behind it, or null."""
    t = trim(c)
    inside, suffix = rf"^\(([^)]+)\){WS}+(.+)$", rf"^([A-Za-z]{{1,7}})([.)]){WS}+(.+)$"
    return F.when(
        t.rlike(inside),
        F.struct(F.regexp_extract(t, inside, 1).alias("body"), F.concat(F.lit("("), F.regexp_extract(t, inside, 1), F.lit(")")).alias("marker"), F.regexp_extract(t, inside, 2).alias("rest")),
    ).when(
        t.rlike(suffix),
        F.struct(F.regexp_extract(t, suffix, 1).alias("body"), F.concat(F.regexp_extract(t, suffix, 1), F.regexp_extract(t, suffix, 2)).alias("marker"), F.regexp_extract(t, suffix, 3).alias("rest")),
    )


def roman_value(c: Column) -> Column:
    """Value of a lower-case roman numeral, whatever its form; null where a letter is none.

    From the right, a letter less than the largest so far is taken off, else it is added.
    """
    value = lambda x: F.get(F.array(*map(F.lit, (1, 5, 10, 50, 100, 500, 1000))), F.instr(F.lit("ivxlcdm"), x) - 1)
    state = F.aggregate(
        F.reverse(F.split(c, "")), F.struct(F.lit(0).alias("total"), F.lit(0).alias("most")),
        lambda s, x: F.struct((s["total"] + F.when(value(x) < s["most"], -value(x)).otherwise(value(x))).alias("total"), F.greatest(s["most"], value(x)).alias("most")),
        lambda s: s["total"],
    )
    return F.when(c.rlike("^[ivxlcdm]+$") & (state > 0), state)


def marker_kinds(body: Column) -> Column:
    """Array of (kind, value): what a marker's body can count as."""
    low = F.lower(body)
    one, lower, upper = body.rlike("^[A-Za-z]$"), body.rlike("^[a-z]+$"), body.rlike("^[A-Z]+$")
    case = F.when(lower, "lower").when(upper, "upper")
    entry = lambda kind, value: F.struct(F.concat(F.lit(kind), case).alias("kind"), value.cast("int").alias("value"))
    alpha = F.when(one, entry("alpha-", F.ascii(low) - 96))
    roman = F.when((lower | upper) & roman_value(low).isNotNull(), entry("roman-", roman_value(low)))
    return F.array_compact(F.array(alpha, roman))


def is_caption(c: Column) -> Column:
    """A caption's word, then a number, an opening bracket and a digit, or a roman numeral."""
    t = F.regexp_replace(c, f"^{WS}+", "")
    return t.rlike(rf"^(?i:{any_of(CAPTION_WORDS)})(?:{WS}*(?:[0-9]|\([0-9])|{WS}+[IVXLC])")


def is_attribution(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+", "").rlike(f"^(?i:{any_of(ATTRIBUTIONS)})")


def is_toc_title(c: Column) -> Column:
    return F.lower(F.regexp_replace(trim(c), ":+$", "")).isin(TOC_TITLES)


TOC = rf"^(.*[^.{WS[1:-1]}])(?:\.|{WS})*{WS}(?:\.|{WS})*([0-9]{{1,4}})$"
TOC_ROMAN = rf"^(.*[^.{WS[1:-1]}])(?:\.|{WS})*{WS}(?:\.|{WS})*([ivxlcdmIVXLCDM]{{2,6}})$"


def toc_number(c: Column) -> Column:
    """Page number of a line of a table of contents: eight letters or more that don't end in a
    digit, white space and dots, one to four digits. Else null."""
    t = trim(c)
    body = F.regexp_extract(t, TOC, 1)
    return F.when(t.rlike(TOC) & (kept(body, r"\p{L}") >= 8) & ~body.rlike("[0-9]$"), F.regexp_extract(t, TOC, 2).cast("int"))


def is_toc_entry(c: Column) -> Column:
    """``toc_number`` isn't null, or a roman page number behind five letters or more."""
    t = trim(c)
    roman = t.rlike(TOC_ROMAN) & (kept(F.regexp_extract(t, TOC_ROMAN, 1), r"\p{L}") >= 5)
    return toc_number(c).isNotNull() | roman


def is_section_number(c: Column) -> Column:
    """A section's number as "1.5", "A.2", "Sec. 3" or "§4"."""
    t = trim(c)
    rest = F.regexp_replace(t, rf"^(?:§|(?:{any_of(SECTION_LEADS)}){WS}*)", "")
    numbered = rest.rlike(r"^(?:[A-Z][0-9]*|[0-9]+)(?:\.(?:[A-Z][0-9]*|[0-9]+))*\.?$") & rest.rlike("[0-9]")
    return (t != "") & ((rest == "") | numbered)


def numbered_level(c: Column) -> Column:
    """Heading level of a numbered title: dots of its number plus one; 1 for a named section."""
    w = words(c)
    first = F.get(w, F.when(F.get(w, 0).rlike("/AS|/as"), 1).otherwise(0))
    number = F.regexp_replace(first, "[.):]+$", "")
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return F.when(F.lower(c).rlike("^(?:section|part|appendix) "), 1).when(number.rlike(r"^[0-9]+(?:\.[0-9]+)*$"), dots + 1)


def has_short_number(c: Column) -> Column:
    stem = F.substring_index(F.regexp_replace(F.get(words(c), 0), "[.):]+$", ""), ".", 1)
    return F.coalesce(stem.rlike("^[0-9]{1,2}$"), F.lit(False))


def is_spec_code(c: Column) -> Column:
    """A word of four digits and up to four more signs, with a title behind it."""
    w = words(c)
    return (F.size(w) >= 2) & F.get(w, 0).rlike("^[0-9]{4}[0-9A-Za-z]{0,4}$")


def level_in_context(c: Column, coded: Column, inside: Column) -> Column:
    """``numbered_level`` where a document is ``coded`` by sections and the title ``inside`` one."""
    deeper = inside & ~is_spec_code(c) & has_short_number(c)
    level = numbered_level(c)
    return F.when(coded & is_spec_code(c), 1).otherwise(F.when(deeper, F.least(level + 1, F.lit(6) + 0 * level)).otherwise(level))


def title_key(c: Column) -> Column:
    """Letters, digits and single blanks in lower case: what makes two titles the same."""
    return collapse(F.lower(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}{WS[1:-1]}]", "")))


def is_page_number_heading(c: Column, pages: Column) -> Column:
    """Three words or more, the last a page of the document, and no standard's number."""
    w = words(c)
    last, n = F.try_element_at(w, F.lit(-1)), F.size(w)
    number = F.when(last.rlike("^[0-9]{1,9}$"), last.cast("int"))
    named = F.exists(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), lambda x: x.rlike(r"\p{L}"))
    before = F.upper(F.regexp_replace(F.get(w, n - 2), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.coalesce((n >= 3) & (number > 0) & ((pages <= 0) | (number <= pages)) & named & ~before.isin(STANDARDS), F.lit(False))


def is_counter_only(c: Column) -> Column:
    return c.rlike(r"^[0-9.\t\n\f\r ]*[0-9][0-9.\t\n\f\r ]*$")


def is_drawing_note(c: Column) -> Column:
    return F.lower(c).rlike(rf"^{WS}*a[0-9]+{WS}+drawing{WS}+page(?:{WS}|$)")


def is_caption_heading(c: Column) -> Column:
    return F.lower(trim(c)).rlike(r"^(?:figure|table)(?: |$)|^fig\. ")


def is_uppercase_title(c: Column) -> Column:
    return (F.size(words(c)) >= 2) & c.rlike(r"\p{L}") & ~c.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]")


def is_amendment(c: Column) -> Column:
    return F.lower(c).rlike("^(?:add|delete|replace) ")


def is_body_sentence(c: Column) -> Column:
    """A sentence that stands as a heading: long with a full stop, a rule, or long with commas."""
    low, n = F.lower(c), F.octet_length(c)
    commas = F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))
    return (
        ((n >= 100) & c.rlike(rf"\.{WS}*$")) | (low.startswith("the ") & low.contains(" shall ") & c.endswith(":"))
        | ((n >= 110) & (commas >= 2) & numbered_level(c).isNull())
    )


def is_priced(c: Column) -> Column:
    return numbered_level(c).isNotNull() & c.contains("$")


def is_log_observation(c: Column) -> Column:
    return c.rlike("^[0-9. ]*@")


def is_contact(c: Column) -> Column:
    return F.lower(c).rlike(r"www\.|https?://")


def is_numbered_sentence(c: Column) -> Column:
    """A number alone, or a numbered sentence of six words or more."""
    w, low = words(c), F.lower(c)
    numbered = F.regexp_replace(F.get(w, 0), "[.)]+$", "").rlike("^[0-9]+$")
    sentence = (F.size(w) >= 7) & (c.rlike("[.;:]$") | low.contains(" will ") | low.contains(" shall "))
    return F.coalesce(numbered, F.lit(False)) & ((F.size(w) == 1) | sentence)


def is_physical_heading(c: Column) -> Column:
    """A short numbered title that begins in upper case and doesn't end in a full stop."""
    w = words(c)
    short = (F.octet_length(c) <= 100) & (F.size(w) <= 12) & ~c.endswith(".")
    told = F.get(w, 0).rlike("^[0-9]") & numbered_level(c).isNotNull() & (F.get(w, 0).contains(".") | is_uppercase_title(c))
    return F.coalesce((F.size(w) >= 2) & told & short & F.get(w, 1).rlike(r"^\p{Lu}"), F.lit(False))


def is_contents_page(c: Column) -> Column:
    """A page of Markdown with three dotted leaders, or the word and one of them or a table."""
    leaders = F.size(F.filter(F.split(c, "\n", -1), lambda x: x.contains("...") & F.regexp_replace(F.regexp_replace(trim(x), r"\*+$", ""), f"{WS}+$", "").rlike("[0-9]$")))
    return (leaders >= 3) | (F.lower(c).contains("contents") & ((leaders > 0) | c.contains("|---")))


def is_rule_artifact(c: Column, width: Column, height: Column) -> Column:
    """What was read of a rule: no letter or digit, or one thin sign that is far taller than wide."""
    t = trim(c)
    thin = t.rlike(r"^[|Il1!ij\[\](){}/\\]$") & (height > 0) & (width < 0.35 * height)
    return ~t.rlike(r"[\p{L}\p{N}]") | thin


def is_chart_label(c: Column) -> Column:
    t = trim(c)
    return (F.length(t) <= 3) | (t.rlike("[0-9]") & t.rlike(r"^[0-9,.%\-+$€£ kKMx]+$"))


def is_alpha_dominant(c: Column) -> Column:
    return kept(c, r"\p{L}") > kept(c, "[0-9]")


def is_value_like(c: Column) -> Column:
    t = trim(c)
    return t.rlike("^[-–—]+$|[$%±]|[0-9][.,][0-9]")


def is_bullet_only(c: Column) -> Column:
    """Bullets alone, or a list's number or letter alone."""
    t = trim(c)
    return t.rlike(rf"^[{BULLET_CELLS}]+$|^\([0-9]{{0,3}}\)$|^\([A-Za-z]\)$|^(?:[0-9]+|[ivxIVX]+|[A-Za-z])[.)]$")


def is_label_like(c: Column) -> Column:
    """Forty characters and four words at most, no bullet, no sentence's end inside."""
    t = trim(c)
    return (t != "") & (F.length(t) <= 40) & ~is_bullet_only(t) & (F.size(words(t)) <= 4) & ~t.rlike(r"\. [A-Z]")


def is_page_ref(c: Column) -> Column:
    return trim(c).rlike("^[0-9]+$|^(?i:[ivxlcdm]{1,6})$")


def looks_like_caption(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, f"^{WS}+", "")).rlike(r"^(?:figure|fig\.|fig|table|tab\.|tab) [0-9]")


def is_margin_number(c: Column) -> Column:
    """One or two digits, perhaps with an O that was read for a zero."""
    return trim(c).rlike("^[0-9]{1,2}O?$")


def alpha_ratio(c: Column) -> Column:
    """Share of letters among the characters that aren't white space; 0 of none."""
    total = F.length(F.regexp_replace(c, WS, ""))
    return F.when(total > 0, kept(c, r"\p{L}") / total).otherwise(0.0)


def heading_role(c: Column) -> Column:
    """Level of a role H1 to H6, or null."""
    number = F.regexp_extract(trim(c), "^[Hh][+]?(0*[1-6])$", 1)
    return F.when(number != "", number.cast("int"))


def is_rtl(c: Column) -> Column:
    """More letters that run to the left than others."""
    left = kept(c, RTL)
    return left > kept(F.regexp_replace(c, RTL, ""), r"\p{L}")


def escape_inline(c: Column) -> Column:
    """Backslashes before what Markdown takes for emphasis: backslash, asterisk, underscore."""
    return F.regexp_replace(c, r"([\\*_])", r"\\$1")


def escape_html(c: Column) -> Column:
    """Text of an HTML cell: the three signs as entities, line breaks as blanks."""
    out = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit("\n"), F.lit(" "))


def emphasis(c: Column, bold: Column, italic: Column) -> Column:
    sign = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    return F.when(trim(c) == "", c).otherwise(F.concat(sign, c, sign))


def ends_hyphenated(c: Column) -> Column:
    return c.rlike(rf"\p{{L}}-{WS}*$")


def ends_sentence(c: Column) -> Column:
    """A full stop, an exclamation or a question mark at the end, closing signs left out."""
    return F.regexp_replace(c, f"{WS}+$", "").rlike(f"[.!?][{CLOSERS}]*$")


def starts_lower(c: Column) -> Column:
    return c.rlike(rf"^{WS}*\p{{Ll}}")


def is_soft_break(before: Column, after: Column) -> Column:
    return ends_hyphenated(before) & starts_lower(after)


def dehyphenate(before: Column, after: Column) -> Column:
    """Two pieces of a text joined: a word cut by a hyphen grows together, else with a blank."""
    whole = F.concat(F.regexp_replace(before, f"-{WS}*$", ""), F.regexp_replace(after, f"^{WS}+", ""))
    return F.when(after == "", before).when(before == "", after).when(is_soft_break(before, after), whole).otherwise(F.concat_ws(" ", before, after))


def code_language(c: Column) -> Column:
    """'json', 'cpp', 'python' or null, by signs of each in a block of code."""
    has = lambda signs: sum((c.contains(s).cast("int") for s in signs), F.lit(0))
    cpp = has(["#include", "std::", "int main", "nullptr", "->", "::", "template<"])
    python = has(["self.", "import ", "from ", "def ", "class ", "print(", "lambda ", "elif ", "f'", 'f"', "__", " for ", "len(", "sorted(", "range("])
    opens = c.rlike(rf"(?m)^{WS}*(?:if |for |while |def |class |elif |else|try|except|with )[^\n]*:[\t\r ]*$")
    json = c.rlike(rf"^{WS}*[{{\[]") & c.contains('":')
    return F.when(json, "json").when(cpp >= 2, "cpp").when((python >= 2) | ((python >= 1) & opens), "python")


# What a font's name says of its style, and the bits of its flags.
BOLD_NAMES = ["Bold", "Black", "Heavy", "Semibold", "Demibold"]
ITALIC_NAMES = ["Italic", "Oblique"]
MONO_NAMES = ["Courier", "Mono", "Consolas", "Menlo", "Source Code", "Inconsolata", "Hack", "Fira Code"]
FIXED_PITCH, ITALIC, FORCE_BOLD = 1, 64, 262144


def _styled(names: list[str], flag: int, name: Column, flags: Column) -> Column:
    return F.coalesce(name.rlike("|".join(names)), F.lit(False)) | F.coalesce(flags.bitwiseAND(F.lit(flag)) != 0, F.lit(False))


def is_bold(name: Column, flags: Column, weight: Column) -> Column:
    return _styled(BOLD_NAMES, FORCE_BOLD, name, flags) | F.coalesce(weight >= 600, F.lit(False))


def is_italic(name: Column, flags: Column) -> Column:
    return _styled(ITALIC_NAMES, ITALIC, name, flags)


def is_mono(name: Column, flags: Column) -> Column:
    return _styled(MONO_NAMES, FIXED_PITCH, name, flags)


def link(inner: Column, url: Column) -> Column:
    """A Markdown link; the address in angle brackets where it has blanks or round brackets."""
    broken = url.rlike(r"[ \t()]")
    return F.concat(F.lit("["), inner, F.when(broken, "](<").otherwise("]("), url, F.when(broken, ">)").otherwise(")"))


def style(inner: Column, bold: Column, italic: Column, mono: Column, strike: Column) -> Column:
    """Markdown signs around a run of text: code wins over emphasis, strike-out is outermost. The
    fence of code is longer than any run of backticks inside."""
    longest = F.array_max(F.transform(F.regexp_extract_all(inner, F.lit("`+"), F.lit(0)), lambda r: F.length(r)))
    fence = F.rpad(F.lit(""), F.coalesce(longest, F.lit(0)) + 1, F.lit("`"))
    code = F.when(longest.isNull(), F.concat(F.lit("`"), inner, F.lit("`"))).otherwise(F.concat(fence, F.lit(" "), inner, F.lit(" "), fence))
    sign = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    told = F.when(mono, code).otherwise(F.concat(sign, inner, sign))
    return F.when(strike, F.concat(F.lit("~~"), told, F.lit("~~"))).otherwise(told)


def plain_punctuation(c: Column) -> Column:
    """Typographic quotes, primes and dashes as ASCII."""
    c = F.regexp_replace(c, "[\u2018\u2019\u201a\u2032]", "'")
    c = F.regexp_replace(c, "[\u201c\u201d\u201e\u2033]", '"')
    return F.regexp_replace(c, "[\u2010-\u2015\u2212]", "-")


def narrow_spaces(c: Column, least: int, width: int) -> Column:
    """Runs of ``least`` blanks or more become ``width`` of them."""
    return F.regexp_replace(c, f" {{{least},}}", " " * width)


def clean_ocr(c: Column) -> Column:
    """Brackets and bars around a number are what was read of a table's borders; a pair of round
    brackets right around it makes it negative and stays."""
    t = trim(c)
    core = trim(F.regexp_replace(t, r"^[|\[\](){}]+|[|\[\](){}]+$", ""))
    number = core.rlike(r"^[0-9,. %\-+*/]+$") | core.isin("N/A", "Z", "-")
    place = F.instr(t, core)
    before, after = F.substr(t, place - 1, F.lit(1)), F.substr(t, place + F.length(core), F.lit(1))
    negative = (place > 1) & (before == "(") & (after == ")")
    return F.when(core == "", t).when(number & negative, F.concat(F.lit("("), core, F.lit(")"))).when(number, core).otherwise(t)


def markdown_heading(c: Column) -> Column:
    """(level, title) of a Markdown heading of up to six signs, or null."""
    pattern = r"^(#{1,6})([\t\n\f\r ].*)$"
    return F.when(c.rlike(pattern), F.struct(F.length(F.regexp_extract(c, pattern, 1)).alias("level"), F.regexp_extract(c, pattern, 2).alias("title")))


def content_length(c: Column) -> Column:
    """Characters but for white space, code fences and rules of five dashes."""
    bare = F.regexp_replace(c, r"(?m)^\s*```[a-zA-Z]*\s*$", "")
    return F.length(F.regexp_replace(F.replace(bare, F.lit("-----"), F.lit("")), WS, ""))
