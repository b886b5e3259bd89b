"""Text functions as Column expressions; all stay in the JVM."""

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[㐀-鿿]"
CODE = r"HJ\s*(11(?:6[6-9]|7[0-6]))\s*[-—]\s*2021"
HEADING = r"(?md)^\s*([0-9]+(?:[.][0-9]+){0,3})\s+[^\n]"
OPERATORS = r"[-=∑×·+−/<>≤≥\[\]{}]"
FUNCTION_NAMES = r"(?iU)\b(exp|sin|cos|ln|max|min)\b"
FORMULA_NUMBER = r"[（(]([A-Z](?:\.\d+)+|\d+(?:\.\d+)?)[）)]"
TABLE_CAPTION = r"^表\s*[A-Z]?(?:\.\s*)?\d"
FIGURE_CAPTION = r"^图\s*\d"
#: Symbol of a definition (up to 30 characters before a double dash) and what it stands for; or a symbol that "is" something.
DEFINITION = r"^(?:式中[：:]?\s*)?([^，,；;。]{1,30}?)\s*(?:——|--)\s*(.+)$"
DEFINITION_IS = r"^(?:式中[：:]?\s*)?([A-Za-zΑ-ωΔλθρ′_,.]{1,16})\s+(为.+)$"
TITLE_PREFIX = "全国生态状况调查评估技术规范"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_space(x: Column | str) -> Column:
    """Runs of any Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def compact(x: Column | str) -> Column:
    """Without white space."""
    return F.regexp_replace(_c(x), r"(?U)\s+", "")


def clean_name(x: Column | str) -> Column:
    """Single spaces, and no list punctuation at the ends."""
    return F.btrim(normalize_space(x), F.lit("；;：:，,。 "))


def stable_id(*parts: Column | str, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the parts joined by a bar; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts)), 256), 1, length)


def json_digest(record: Column | str) -> Column:
    """SHA-256 of a value's JSON with sorted keys at every depth, no white space, nulls included."""
    return F.sha2(_sorted_json()(F.to_json(_c(record), {"ignoreNullFields": "false"})), 256)


def _sorted_json():
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else json.dumps(json.loads(v), ensure_ascii=False, sort_keys=True, separators=(",", ":")))

    return run


def standard_code(text: Column | str, filename: Column | str | None = None) -> Column:
    """``HJ n-2021`` from the text, else from the file name, else ''."""
    found = F.regexp_extract(_c(text), CODE, 1)
    if filename is not None:
        found = F.when(found == "", F.regexp_extract(_c(filename), CODE, 1)).otherwise(found)
    return F.when(F.coalesce(found, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("HJ "), found, F.lit("-2021")))


def title(text: Column | str, fallback: Column | str) -> Column:
    """The first line that begins with a double dash, without it; else the file name without ending, number and the series' name."""
    lines = F.filter(F.transform(F.split(_c(text), r"[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"), normalize_space), lambda x: x.startswith("——") & (F.length(x) > 2))
    stem = F.regexp_replace(F.regexp_extract(_c(fallback), r"([^/]*)$", 1), r"(?<=[^.])\.[^.]*$", "")
    stem = F.regexp_replace(F.regexp_replace(stem, r"^\d+\.", ""), TITLE_PREFIX + "[—（(]?", "")
    return F.coalesce(F.trim(F.ltrim(F.get(lines, F.lit(0)), F.lit("—"))), F.rtrim(stem, F.lit("）)")))


def first_heading(text: Column | str) -> Column:
    """The number of the first numbered heading, a Chinese full stop counting as a line's end; null where there is none."""
    return F.nullif(F.regexp_extract(F.replace(_c(text), F.lit("。"), F.lit("\n")), HEADING, 1), F.lit(""))


def block_kind(x: Column | str) -> Column:
    """formula, table, figure_caption or paragraph; the first rule that fits."""
    x = _c(x)
    return (
        F.when(x.rlike(r"式中|公式[（(]?[A-Z]?\d"), "formula")
        .when(x.rlike(r"(?U)(^|\s)表\s*[A-Z]?\d"), "table")
        .when(x.rlike(r"(?U)(^|\s)图\s*\d"), "figure_caption")
        .otherwise("paragraph")
    )


EXTERNAL_TEST = ("HJ 1171-2021", "HJ 1174-2021", "HJ 1175-2021")
CORE = ("HJ 1172-2021", "HJ 1173-2021")


def role(code: Column | str) -> Column:
    code = _c(code)
    return F.when(code.isin(*EXTERNAL_TEST), "external_test").when(code.isin(*CORE), "core").otherwise("support")


def terms(x: Column | str) -> Column:
    """Adjacent character pairs of the lower-case text without white space, then its Latin tokens; repeats stay."""
    # an array of characters: substring counts from the start of a text each time, and a lambda computes again what it closes over
    chars = F.split(compact(F.lower(_c(x))), "")
    pairs = F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.concat(pairs, F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[a-z0-9_@.\-]+"), F.lit(0)))


def bucket(key: Column | str, seed: int) -> Column:
    """A number in [0, 1] from the seeded hash of a key."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), _c(key)), 256), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(4294967295.0)


def hash_mod(key: Column | str, modulus: int) -> Column:
    """The first 64 bits of a key's SHA-256 modulo a number."""
    return (F.conv(F.substring(F.sha2(_c(key), 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(modulus)).cast("int")


#: Low bytes of the private-use characters that a symbol font leaves behind, and what they show.
_SYMBOLS = dict(
    zip(
        (chr(0xF000 + int(x, 16)) for x in "28 29 2b 2d 3d 44 5b 5d 61 62 6c 71 72 a2 b0 b4 d7 e5 e6 e7 e8 e9 eb ec ed ee ef f6 f7 f8 f9 fb".split()),
        "()+−=Δ[]αβλθρ′°×·∑⎛⎝⎞⎡⎧⎤⎨⎩⎪⎜⎟⎠⎣⎬",
        strict=True,
    )
)


def normalize_pdf_text(x: Column | str) -> Column:
    """Private-use symbols of PDF fonts as their Unicode characters, hard spaces as spaces, single blanks."""
    x = F.translate(_c(x), "".join(_SYMBOLS) + "\u00a0", "".join(_SYMBOLS.values()) + " ")
    return F.trim(F.regexp_replace(x, r"[ \t]+", " "))


def round_box(box: Column | str) -> Column:
    return F.transform(_c(box), lambda v: F.bround(v, 3))


def has_cjk(x: Column | str) -> Column:
    return _c(x).rlike(CJK)


def has_operator(x: Column | str) -> Column:
    return _c(x).rlike(OPERATORS) | _c(x).rlike(FUNCTION_NAMES)


def formula_number(x: Column | str) -> Column:
    return F.regexp_extract(_c(x), FORMULA_NUMBER, 1)


def is_formula_anchor(x: Column | str) -> Column:
    return (formula_number(x) != "") & has_operator(x)


def is_formula_fragment(x: Column | str, height: Column | str, anchor_height: Column | str) -> Column:
    x = _c(x)
    small = _c(height) <= 0.75 * _c(anchor_height)
    cjk = F.length(F.regexp_replace(x, "[^㐀-鿿]", ""))
    token = x.rlike(r"[-A-Za-z0-9=∑×·+−/<>≤≥]")
    return ~x.rlike(r"[：:。；;]$") & ((cjk == 0) | ((F.length(x) <= 30) & (small | ((cjk <= 2) & token))))


def is_definition(x: Column | str) -> Column:
    x = _c(x)
    return x.rlike(DEFINITION) | x.rlike(DEFINITION_IS) | x.startswith("式中")


def bridges_formula(x: Column | str) -> Column:
    """Whether a paragraph leads over to another formula."""
    return _c(x).rlike(r"[：:]$|计算公式|公式如下|计算如下|侵蚀量|风力侵蚀")


def is_header_or_footer(x: Column | str, top: Column | str, bottom: Column | str, page_height: Column | str) -> Column:
    x = _c(x)
    return ((_c(top) < 105) & x.rlike(r"^HJ\s*\d{4}[—-]\d{4}$")) | ((_c(bottom) > _c(page_height) - 70) & x.rlike(r"^\d+$"))


def heading_parts(x: Column | str) -> Column:
    """(section, title) of an appendix, lettered or numbered heading; null for other lines."""
    x = _c(x)
    lettered, numbered = r"^([A-Z]\.\d+(?:\.\d+)*)\s+([㐀-鿿].{0,80})$", r"^(\d{1,2}(?:\.\d{1,2}){0,3})\s+([㐀-鿿].{0,80})$"
    appendix = F.nullif(F.regexp_extract(x, r"^附\s*录\s*([A-Z])$", 1), F.lit(""))
    part = lambda p: F.struct(F.regexp_extract(x, p, 1).alias("section"), F.regexp_extract(x, p, 2).alias("title"))
    first = F.split_part(F.regexp_extract(x, numbered, 1), F.lit("."), F.lit(1)).cast("int")
    return (
        F.when(appendix.isNotNull(), F.struct(F.concat(F.lit("附录 "), appendix).alias("section"), F.lit("").alias("title")))
        .when(is_formula_anchor(x), F.lit(None))
        .when(x.rlike(lettered), part(lettered))
        .when(x.rlike(numbered) & (first <= 30) & ~F.regexp_extract(x, numbered, 2).startswith("式中"), part(numbered))
    )


def line_kind(x: Column | str, header_footer: Column, in_table: Column) -> Column:
    x = _c(x)
    return (
        F.when(header_footer, "header_footer")
        .when(in_table, "table_cell")
        .when(is_formula_anchor(x), "formula")
        .when(x.rlike(TABLE_CAPTION), "table_caption")
        .when(x.rlike(FIGURE_CAPTION), "figure_caption")
        .when(heading_parts(x).isNotNull(), "heading")
        .otherwise("paragraph")
    )


def matched(x: Column | str, pattern: str) -> Column:
    """Distinct matches of a pattern in order of their text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(0))))


def _literals(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def gazetteer(x: Column | str, words: list[str]) -> Column:
    """Words that the text contains, nested ones too, in the order given."""
    return F.filter(_literals(words), lambda w: F.contains(_c(x), w))


def gazetteer_maximal(x: Column | str, words: list[str]) -> Column:
    """Words that the text contains and that lie in no other such word."""
    hits = gazetteer(x, words)
    return F.filter(hits, lambda w: ~F.exists(hits, lambda o: (o != w) & F.contains(o, w)))


def gazetteer_first(x: Column | str, words: list[str]) -> Column:
    """Words that the text contains, but for those inside a word already kept."""
    none = F.array().cast("array<string>")
    return F.aggregate(gazetteer(x, words), none, lambda kept, w: F.when(F.exists(kept, lambda k: F.contains(k, w)), kept).otherwise(F.concat(kept, F.array(w))))


def unit_of(definition: Column | str) -> Column:
    """What follows the last comma of a definition, if it has a sign, digit or letter of a unit of measure; else ''."""
    last = F.trim(F.regexp_extract(_c(definition), r"[，,]([^，,；;。]{1,40})[；;。]?$", 1))
    return F.when(last.rlike("[%％/∙·0-9A-Za-z]|量纲"), last).otherwise(F.lit(""))


def symbol_base(x: Column | str) -> Column:
    return F.btrim(F.split(_c(x), r"[_\s]", 2)[0], F.lit("'′"))


def compact_math(x: Column | str) -> Column:
    return F.translate(F.regexp_replace(_c(x), r"[\s_{}]", ""), "（）", "()")


def symbol_identity(x: Column | str) -> Column:
    return F.translate(compact_math(x), "，’'", ",′′")


def symbol_occurs(symbol: Column | str, expression: Column | str, fold: bool = True) -> Column:
    """Whether a symbol, its kinds of primes and commas made equal where ``fold`` is set, or its base stands in an expression."""
    s, e = symbol_identity(symbol) if fold else compact_math(symbol), compact_math(expression)
    base = compact_math(symbol_base(symbol))
    return (F.contains(e, s) & (s != "")) | (F.contains(e, base) & (base != ""))


def split_compound(x: Column | str) -> Column:
    """The single letters of ``A、B和C``; other values as they are."""
    x = _c(x)
    return F.when(x.rlike("^[A-Za-z](?:、[A-Za-z])+(?:和[A-Za-z])?$"), F.regexp_extract_all(x, F.lit("[A-Za-z]"), F.lit(0))).otherwise(F.array(x))


def lhs_symbols(expression: Column | str) -> Column:
    """For each equals sign the symbol that ends the line or clause before it, in compact form, each once."""
    x = _c(expression)
    parts = F.split(x, "=")
    places = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    # the text before the k-th sign
    before = F.transform(places, lambda k: F.array_join(F.slice(parts, F.lit(1), k), "="))
    segment = F.transform(before, lambda t: F.regexp_replace(F.trim(F.regexp_extract(t, r"([^;\n]*)$", 1)), "^[^A-Za-zͰ-Ͽ一-鿿]+", ""))
    symbol = r"([A-Za-zͰ-Ͽ一-鿿]+[′’']?(?:_[A-Za-z0-9,]+)?(?:\s*\([^()=]{1,20}\))?)\s*$"
    return unique(F.transform(segment, lambda t: compact_math(F.regexp_extract(t, symbol, 1))))


def output_symbols(expression: Column | str, declared: Column | str) -> Column:
    """Left-hand symbols as declared: the first symbol of equal identity, else the only one of equal base, else itself."""
    declared = _c(declared)
    base_of = lambda s: symbol_identity(symbol_base(s))

    def resolve(s: Column) -> Column:
        same = F.filter(declared, lambda d: symbol_identity(d) == symbol_identity(s))
        base = F.filter(declared, lambda d: base_of(d) == base_of(s))
        return F.coalesce(F.get(same, F.lit(0)), F.when(F.size(base) == 1, F.get(base, F.lit(0))), s)

    return unique(F.transform(lhs_symbols(expression), resolve))


def heading_title(chain: Column | str) -> Column:
    """The last heading of a chain without its number."""
    last = F.coalesce(F.try_element_at(_c(chain), F.lit(-1)), F.lit(""))
    return clean_name(F.regexp_replace(last, r"^(?:附录\s*[A-Z]|[A-Z]?\d+(?:\.\d+)*)\s*", ""))


def indicator_heading(chain: Column | str) -> Column:
    return F.trim(F.regexp_replace(heading_title(chain), r"[（(][A-Za-z]+[）)]\s*$", ""))


def clean_formula(x: Column | str) -> Column:
    return F.regexp_replace(F.btrim(_c(x), F.lit(" ：:")), "^(?:修正|通用)(?=水量平衡方程$)", "")


def clean_indicator(x: Column | str) -> Column:
    return F.regexp_replace(F.btrim(_c(x), F.lit(" ：:")), "^生态系统的?", "")


def subject_name(document_title: Column | str) -> Column:
    """What a title ending in 评估 is about, else ''."""
    return F.trim(F.regexp_extract(_c(document_title), r"^(.*?)评估$", 1))


def unique(values: Column | str) -> Column:
    """Distinct values that aren't null or empty, in the order of first sight."""
    return F.array_distinct(F.filter(_c(values), lambda v: v.isNotNull() & (v != "")))


def display(x: Column, placeholder: str = "待实验补充") -> Column:
    """Four decimals; a placeholder for null."""
    return F.when(x.isNull(), placeholder).otherwise(F.format_string("%.4f", x))


def teaser(x: Column | str, most: int = 320) -> Column:
    x = _c(x)
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("…"))).otherwise(x)


def fenced_json(x: Column | str) -> Column:
    """The JSON of a model's answer: without its code fence, else from the first brace to the last; null where neither parses."""
    bare = F.trim(F.regexp_replace(_c(x), r"^\s*```(?:json)?\s*|\s*```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(inner))


def forbidden_paths(x: Column | str, keys: list[str]) -> Column:
    """JSON paths ($.a.b[0]) of forbidden keys at any depth of a JSON text; null where it doesn't parse."""
    return _forbidden(keys)(_c(x))


def sanitized(x: Column | str, keys: list[str]) -> Column:
    """(value, removed): the JSON text without forbidden keys, and their paths."""
    return _sanitize(keys)(_c(x))


def _walk(value, keys: frozenset[str], prefix: str, removed: list[str]):
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            if k in keys:
                removed.append(f"{prefix}.{k}")
            else:
                out[k] = _walk(v, keys, f"{prefix}.{k}", removed)
        return out
    if isinstance(value, list):
        return [_walk(v, keys, f"{prefix}[{i}]", removed) for i, v in enumerate(value)]
    return value


def _forbidden(keys: list[str]):
    wanted = frozenset(keys)

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        def one(text):
            found: list[str] = []
            try:
                _scan(json.loads(text), wanted, "$", found)
            except (TypeError, ValueError):
                return None
            return found

        return pd.Series([one(v) for v in values])

    return run


def _scan(value, keys: frozenset[str], prefix: str, found: list[str]) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            if k in keys:
                found.append(f"{prefix}.{k}")
            _scan(v, keys, f"{prefix}.{k}", found)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            _scan(v, keys, f"{prefix}[{i}]", found)


def _sanitize(keys: list[str]):
    wanted = frozenset(keys)

    @F.pandas_udf("struct<value:string,removed:array<string>>")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for text in values:
            removed: list[str] = []
            try:
                clean = _walk(json.loads(text), wanted, "$", removed)
            except (TypeError, ValueError):
                rows.append((None, None))
            else:
                rows.append((json.dumps(clean, ensure_ascii=False, separators=(",", ":")), removed))
        return pd.DataFrame(rows, columns=["value", "removed"])

    return run
