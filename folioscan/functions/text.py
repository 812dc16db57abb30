"""Text functions as column expressions. Null text counts as empty unless a function says otherwise."""
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of punctuation, words, numbers, years, clauses, ids and amounts, and the character bounds that go with them.
PUNCT = r"(?U)[\s，。、“”‘’：:；;（）()【】\[\]《》<>？?！!,.·/\\|+\-=*_#`~^$@]+"
WORD = r"[A-Za-z0-9][A-Za-z0-9._%/-]*|[一-鿿]{2,}"
CJK = r"[一-鿿]"
NUMBER = r"(?U)(?<![\dA-Za-z])[-+]?\d+(?:,\d{3})*(?:\.\d+)?%?"
YEAR = r"(?U)(?:19|20)\d{2}"
CLAUSE = r"(?U)第[一二三四五六七八九十百千万零〇两\d]+[条章节款项]"
DOC_ID_NUMBER = r"(?U)(?i)\b(?:[A-Za-z]+(?:[_-][A-Za-z]+)*|fc_text|text|doc|pdf)[_-]?\d+\b"
SCENARIO_DAY = r"(?U)第\s*([-+]?\d+(?:,\d{3})*(?:\.\d+)?)\s*天"
AMOUNT = r"(?U)(?<![\w.])\(?[-+−]?\$?\s*(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\)?\s*%?(?!\w|\.\d)"
NUMBERS, SEED_NUMBERS, REPAIRED_NUMBERS, PHRASES = 120, 80, 200, 60
LONGEST_RUN, SEED_LONGEST_RUN = 8, 6


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(_or_empty(text), r"(?U)^\s+|\s+$", "")


# The entities that page sources use, the ampersand last.
ENTITIES = (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("#39", "'"), ("apos", "'"), ("amp", "&"))


def unescape(text: Column, bare: tuple[str, ...] | None = None) -> Column:
    """The named entities of ENTITIES decoded once, with a semicolon, and those of `bare` (all of them by default) without one; others stay."""
    out = text
    for name, char in ENTITIES:
        out = F.regexp_replace(out, f"&{name};{'?' if bare is None or name in bare else ''}", char.replace("\\", "\\\\").replace("$", "\\$"))
    return F.when(text.contains("&"), out).otherwise(text)


def clean(text: Column, bare: tuple[str, ...] | None = None) -> Column:
    """Entities decoded, no byte-order marks, runs of blanks made one, at most one empty line in a row, stripped."""
    out = F.replace(unescape(_or_empty(text), bare), F.lit("﻿"), F.lit(""))
    return strip(F.regexp_replace(F.regexp_replace(out, r"[ \t\r\x0B]+", " "), r"\n{3,}", "\n\n"))


def normalized(text: Column) -> Column:
    """Lower case without white space and punctuation."""
    return F.regexp_replace(F.lower(_or_empty(text)), PUNCT, "")


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_or_empty(text), F.lit(pattern), F.lit(group))


def numbers(text: Column, limit: int = NUMBERS) -> Column:
    return F.slice(found(text, NUMBER), 1, limit)


def numbers_repaired(text: Column, limit: int = REPAIRED_NUMBERS) -> Column:
    """Numbers without a sign that stands for a range or belongs to a date.

    A minus goes after a digit followed by at most eight other characters; either sign goes before a year alone or right after a digit."""
    t = _or_empty(text)
    spans = F.split(F.regexp_replace(t, NUMBER.replace("(?U)", "(?U)(") + ")", "\x01$1\x01"), "\x01")

    def one(x: Column, i: Column) -> Column:
        before = F.rtrim(F.regexp_replace(F.array_join(F.slice(spans, 1, i), ""), r"(?U)\s+$", ""))
        range_ = x.startswith("-") & before.rlike(r"(?U)\d\s*[^，,。；;：:\s]{0,8}$")
        bare = x.rlike(r"(?U)^[-+](?:19|20)\d{2}$") | (x.rlike("^[-+]") & before.rlike(r"(?U)\d$"))
        return F.when(range_ | bare, F.substr(x, F.lit(2))).otherwise(x)

    made = F.transform(spans, lambda x, i: F.when(i % 2 == 1, one(x, i)))
    return F.slice(F.filter(made, lambda x: x.isNotNull()), 1, limit)


def years(text: Column) -> Column:
    """Distinct years in order."""
    return F.array_sort(F.array_distinct(found(text, YEAR)))


def clauses(text: Column) -> Column:
    """Distinct clause references in order."""
    return F.array_sort(F.array_distinct(found(text, CLAUSE)))


def grams(x: Column, n: int) -> Column:
    """All n-grams of x, repeats kept; none if x is shorter."""
    return F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substr(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams of the normalized text; a shorter one is itself, an empty one has none."""

    def of(x: Column) -> Column:
        few = F.when(F.length(x) > 0, F.array(x)).otherwise(F.array().cast("array<string>"))
        return F.when(F.length(x) < n, few).otherwise(F.array_distinct(grams(x, n)))

    return let(normalized(text), of)


def tokens(text: Column, longest: int = LONGEST_RUN, limit: int = NUMBERS) -> Column:
    """Lower-case words, then numbers, of two or more characters, repeats kept; a run of CJK characters gives itself, unless long, and its 2- to 4-grams."""
    t = _or_empty(text)
    lowered = F.transform(found(t, WORD), F.lower)
    whole = lambda x: F.when(F.length(x) <= longest, F.array(x)).otherwise(F.array().cast("array<string>"))
    parts = lambda x: F.when(x.rlike(f"^{CJK}+$"), F.concat(whole(x), grams(x, 2), grams(x, 3), grams(x, 4))).otherwise(F.array(x))
    words = F.when(t.rlike(CJK), F.flatten(F.transform(lowered, parts))).otherwise(lowered)
    return F.filter(F.concat(words, F.transform(numbers(t, limit), F.lower)), lambda x: F.length(x) >= 2)


def token_counts(text: Column) -> Column:
    """array<struct(token, n)> in order of first occurrence."""
    count = lambda all_: F.transform(F.array_distinct(all_), lambda x: F.struct(x.alias("token"), F.size(F.filter(all_, lambda y: y == x)).alias("n")))
    return let(tokens(text), count)


def first_by(items: Column, keys: Column, limit: int) -> Column:
    """The first item of each non-empty key, in order, `limit` at most."""

    def pick(k: Column) -> Column:
        return F.filter(F.transform(items, lambda x, i: F.when((F.get(k, i) != "") & (F.array_position(k, F.get(k, i)) == i + 1), x)), lambda x: x.isNotNull())

    return F.slice(let(keys, pick), 1, limit)


def keyphrases(text: Column, limit: int = PHRASES) -> Column:
    """Words of three or more characters, then numbers, then clauses, the first of each normalized form."""
    items = F.concat(F.filter(found(text, WORD), lambda x: F.length(x) >= 3), numbers(text), clauses(text))
    return let(items, lambda a: first_by(a, F.transform(a, normalized), limit))


def keyphrases_seed(text: Column, limit: int = 40) -> Column:
    """The seed path's variant: told apart by lower case, no clauses."""
    items = F.concat(F.filter(found(text, WORD), lambda x: F.length(x) >= 3), numbers(text, SEED_NUMBERS))
    return let(items, lambda a: first_by(a, F.transform(a, F.lower), limit))


def required_numbers(text: Column) -> Column:
    """Numbers that evidence must show: none of ids, none that count days of a scenario; repeats kept."""
    scrubbed = F.regexp_replace(_or_empty(text), DOC_ID_NUMBER, " ")
    return let(found(scrubbed, SCENARIO_DAY, 1), lambda days: F.filter(numbers(scrubbed), lambda x: ~F.array_contains(days, x)))


def suspicious_negative(token: Column, text: Column) -> Column:
    """Whether a signed number isn't in text, or stands at most eight characters after a digit: its sign may be a dash."""
    at = F.instr(_or_empty(text), token)
    before = F.regexp_replace(F.substr(text, F.lit(1), F.greatest(at - 1, F.lit(0))), r"(?U)\s+$", "")
    return (at == 0) | before.rlike(r"(?U)\d\s*[^，,。；;：:\s]{0,8}$")


def number_of(token: Column) -> Column:
    """A financial literal as a decimal: no separators, currency or percent sign; (x) is -x; null beyond 1e24 or if it is no number."""
    bare = F.regexp_replace(F.translate(F.trim(token), ",$ ", ""), "−", "-")
    bare = F.regexp_replace(bare, "%+$", "")
    bare = F.when(bare.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.substr(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)
    value = bare.try_cast("decimal(38,10)")
    return F.when(F.abs(value) <= F.lit("1000000000000000000000000").cast("decimal(38,10)"), value)


def canonical_token(token: Column) -> Column:
    return F.regexp_replace(F.translate(F.trim(token), "$ ", ""), "−", "-")


def holds_token(text: Column, token: Column) -> Column:
    """Whether token is a whole number of text and no part of one."""
    return F.array_contains(F.transform(found(text, AMOUNT), canonical_token), canonical_token(token))


def doc_aliases(doc_id: Column, domain: Column) -> Column:
    """Every form under which a question may name a numbered document, sorted."""
    pad = lambda n, width: F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n)
    n = F.regexp_replace(F.regexp_extract(doc_id, r"^(?:text)?0*(\d+)$", 1), "^$", "")
    text = doc_id.rlike(r"^text0*\d+$")
    digits = doc_id.rlike(r"^\d+$")
    of_text = F.array(F.concat(F.lit("text"), n), F.concat(F.lit("text"), pad(n, 2)), F.concat(F.lit("text"), pad(n, 3)))
    contract = F.array(F.concat(F.lit("fc_text_"), n), F.concat(F.lit("fc_text_"), pad(n, 2)), F.concat(F.lit("fc_text_"), pad(n, 3)), F.concat(F.lit("financial_contracts_text_"), pad(n, 3)))
    policy = F.array(F.concat(F.lit("ins_"), n), F.concat(F.lit("insurance_"), n), F.concat(F.lit("保险"), n))
    none = F.array().cast("array<string>")
    more = F.when(text & (domain == "financial_contracts"), F.concat(of_text, contract)).when(text, of_text)
    more = more.when(digits & (domain == "insurance"), F.concat(F.array(n, pad(n, 2), pad(n, 3)), policy)).when(digits, F.array(n, pad(n, 2), pad(n, 3))).otherwise(none)
    return F.array_sort(F.array_distinct(F.concat(F.array(doc_id), more)))


def safe_name(name: Column) -> Column:
    """Fit for a file name: other characters made one underscore, bare ends, 160 characters at most; a hash where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(name, r"[^0-9A-Za-z._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.left(F.when(bare == "", F.left(F.sha1(name), F.lit(12))).otherwise(bare), F.lit(160))


def qualified_id(doc_id: Column, object_id: Column) -> Column:
    """object_id under its document, unless it already is; null where there is none."""
    own = F.when(object_id.startswith(F.concat(doc_id, F.lit("::"))), object_id).otherwise(F.concat_ws("::", doc_id, object_id))
    return F.when(object_id.isNotNull() & (object_id != ""), own)


def sha1_span(doc_id: Column, start: Column, end: Column, text: Column) -> Column:
    part = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.sha1(F.concat_ws(":", part(doc_id), part(start), part(end), _or_empty(text)))


def table_row_text(header: Column, row: Column) -> Column:
    """'the R of H is C ;' for each cell of a row after its first, R."""
    cells = F.transform(F.arrays_zip(F.slice(header, 2, F.greatest(F.size(header), F.lit(1))).alias("h"), F.slice(row, 2, F.greatest(F.size(row), F.lit(1))).alias("c")), lambda x: F.struct(x["h"].alias("h"), x["c"].alias("c")))
    both = F.filter(cells, lambda x: x.h.isNotNull() & x.c.isNotNull())
    body = F.array_join(F.transform(both, lambda x: F.concat(F.lit("the "), F.get(row, F.lit(0)), F.lit(" of "), x.h, F.lit(" is "), x.c, F.lit(" ; "))), "")
    head = F.get(header, F.lit(0))
    return F.trim(F.regexp_replace(F.concat(F.when(head != "", F.concat(head, F.lit(" "))).otherwise(""), body), " +", " "))


def table_text(caption: Column, html_text: Column, footnote: Column) -> Column:
    """Caption, text and footnote in one line, empty ones left out, cleaned."""
    return clean(F.array_join(F.filter(F.transform(F.array(caption, html_text, footnote), lambda x: F.coalesce(x, F.lit(""))), lambda x: x != ""), " "))


def source_title(text: Column, fallback: Column) -> Column:
    """The first line that isn't blank, cleaned, 200 characters at most."""
    lines = F.filter(F.transform(F.split(_or_empty(text), r"\r\n|\n|\r"), lambda x: strip(F.regexp_replace(unescape(x), r"[ \t\r\f\x0B]+", " "))), lambda x: x != "")
    return F.coalesce(F.left(F.get(lines, F.lit(0)), F.lit(200)), fallback)


def page_offset(name: Column) -> Column:
    """Pages before a part, from a folder name with _p<first>-<last>; 0 for others."""
    return F.greatest(F.coalesce(F.regexp_extract(name, r"_p(\d+)-(\d+)", 1).try_cast("int") - 1, F.lit(0)), F.lit(0))


# Fixed value: the sum of tokens at which the experiment's score stops rewarding thrift.
TOKEN_BUDGET = 5_000_000


def token_score(total: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(TOKEN_BUDGET) - total) / TOKEN_BUDGET))


def experiment_score(accuracy: Column, total: Column) -> Column:
    return 100 * accuracy * (0.7 + 0.3 * token_score(total))


def is_close(a: Column, b: Column, rel: float = 1e-9, abs_: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))


def window_starts(text: Column, size: int, overlap: int) -> Column:
    """0-based starts of fixed windows; the last is the first that reaches the end."""
    return F.when(F.length(text) > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - overlap - 1), F.lit(size - overlap)))
