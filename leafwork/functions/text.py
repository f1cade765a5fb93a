"""Text expressions: all built from Spark's own functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that hint at mathematics (fixed value).
MATH_HINTS = "≤≥≠≈≡±×÷∑∏∫√∞→←⇒⇔∈∉⊂⊃∂∇∆αβγδεζηθικλμνξπρστυφχψωΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ^_*/=+()[]{}"
# Headings by their form: numbers, chapters, paragraph signs, short Chinese titles (fixed value).
HEADING = r"(?U)^(\s*\d+([.、．]\d+)*[.、．]?\s*|\s*第[一二三四五六七八九十百千万0-9]+[章节篇部分]?\s*|\s*§\s*\d+[.\d]*\s*|\s*(CHAPTER|Chapter|Chapter\s+\d+)\s*|\s*[\x{4e00}-\x{9fff}]{1,8}\s*)$"
NOT_IN_TITLES = "，。；："
MAX_TEXT = 2000
_SPACE = r"\s\x{1c}-\x{1f}"


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, rf"(?U)^[{_SPACE}]+|[{_SPACE}]+$", "")


def split_lines(c: Column) -> Column:
    """Lines, at every line boundary of Unicode; a final boundary opens no line."""
    return F.split(F.regexp_replace(c, r"(\r\n|[\n\r\x{b}\x{c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}])$", ""), r"\r\n|[\n\r\x{b}\x{c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]")


def has_cjk(c: Column) -> Column:
    return c.rlike(r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]")


def clip(c: Column, n: int = MAX_TEXT) -> Column:
    return F.substring(c, 1, n)


def math_count(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, MATH_HINTS, ""))


def classify(text: Column, mean_height: Column) -> Column:
    """equation, heading or text, in this order of precedence; null text gives text."""
    t = strip(text)
    n, m = F.length(t), math_count(t)
    return (
        F.when(t.isNull() | (t == ""), "text")
        .when((m >= 2) & (m / n > 0.15), "equation")
        .when((n <= 40) & t.rlike(HEADING), "heading")
        .when((mean_height > 40) & (n <= 30) & (F.instr(t, NOT_IN_TITLES) == 0), "heading")
        .otherwise("text")
    )


# LaTeX commands and the signs they stand for (fixed values).
LATEX = {"Rightarrow": "→", "rightarrow": "→", "to": "→", "Leftarrow": "←", "leftarrow": "←", "Leftrightarrow": "↔", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "approx": "≈", "equiv": "≡", "pm": "±", "times": "×", "div": "÷", "cdot": "·", "sum": "∑", "prod": "∏", "int": "∫", "infty": "∞", "partial": "∂", "nabla": "∇", "in": "∈", "notin": "∉", "subset": "⊂", "supset": "⊃", "cup": "∪", "cap": "∩",
         "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ", "phi": "φ", "omega": "ω", "Delta": "Δ", "Sigma": "Σ", "Omega": "Ω"}


def latex_plain(c: Column) -> Column:
    """LaTeX commands as signs; text without a backslash, and commands that are not known, stay as they are."""
    out = c
    for name in sorted(LATEX, key=lambda k: (-len(k), k)):
        out = F.regexp_replace(out, rf"\\{name}(?![A-Za-z])", LATEX[name])
    return F.when(F.contains(c, F.lit("\\")), out).otherwise(c)


def localised(texts: Column, locale: Column, key: Column, fallback: str = "en") -> Column:
    """A text by locale and key from a map of maps; else in the fallback locale, else the key."""
    return F.coalesce(F.try_element_at(F.try_element_at(texts, locale), key), F.try_element_at(F.try_element_at(texts, F.lit(fallback)), key), key)


# Signs that common fonts lack and their like; operators that stand close to what follows (fixed values).
GLYPHS, OPERATORS = ("⩽⩾⇒⇐⇔", "≤≥→←↔"), "×÷±≤≥⩽⩾≠≈≡∼∈∉⊂⊃∪∩→←↑↓⇒⇐⇔"


def tidy_formula(c: Column) -> Column:
    """Formula text on one line with tight bars, exponents and operators, and glyphs that common fonts have."""
    lines = F.filter(F.transform(split_lines(c), strip), lambda x: x != "")
    t = strip(F.regexp_replace(F.array_join(lines, " "), " {2,}", " "))
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\|\s+", "|"), r"(?U)\s+\|", "|")
    t = F.translate(t, *GLYPHS)
    t = F.regexp_replace(t, r"(?U)\b(\d)\s+(\d)\b", "$1$2")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s*\^\s*", "^"), r"(?U)(\^[-+])\s+", "$1")
    return F.regexp_replace(t, rf"(?U)([{OPERATORS}])\s+", "$1")


def font_of(c: Column) -> Column:
    """The built-in font for a text: its first character beyond Latin-1 decides."""
    first = F.regexp_extract(c, r"[^\x00-\xff]", 0)
    return F.when(first == "", "helv").when(first.rlike(r"[\x{3040}-\x{30ff}]"), "japan").when(first.rlike(r"[\x{ac00}-\x{d7af}]"), "korea").otherwise("china-s")


def language_key(c: Column) -> Column:
    """Languages of a recogniser call: split at plus signs and blanks, joined by plus; eng where none is given."""
    parts = F.filter(F.split(c, r"[+ ]"), lambda x: F.trim(x) != "")
    return F.when(c.isNull() | (F.size(parts) == 0), "eng").otherwise(F.array_join(F.transform(parts, F.trim), "+"))


def truthy(c: Column) -> Column:
    return ~F.lower(F.trim(c)).isin("false", "0", "no", "off", "")


def positive(c: Column, default: float) -> Column:
    """A number above zero, else the default."""
    n = c.try_cast("double")
    return F.when((n > 0) & ~F.isnan(n), n).otherwise(F.lit(default))


def mask(c: Column) -> Column:
    """A secret with at most its first and last four characters."""
    n = F.length(c)
    return F.when(n == 0, "").when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(c, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(c, F.lit(4))))


def byte_size(c: Column) -> Column:
    """Bytes for reading: base 1024, no decimals for bytes and from 100 up, else one."""
    out = F.lit("0 B")
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        v = c / float(1024**i)
        shown = F.concat(F.when((v >= 100) | F.lit(i == 0), F.format_string("%.0f", v)).otherwise(F.format_string("%.1f", v)), F.lit(f" {unit}"))
        out = F.when(c >= 1024**i, shown).otherwise(out)
    return out


def fill(template: Column, values: dict[str, Column]) -> Column:
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v.cast("string"))
    return template


def chat_content(raw: Column) -> Column:
    """The message of a chat answer; empty where the answer has another shape."""
    return F.coalesce(F.get_json_object(raw, "$.choices[0].message.content"), F.lit(""))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)
