"""Fields of a research plan: currencies, contracts, display, kinds of sources, logs, and JSON in texts."""

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import web

#: Currency codes that count as such. Fixed values.
CURRENCIES = ("CHF", "CZK", "EUR", "GBP", "PLN", "USD")
#: Words of a currency, in this order after its codes. Fixed values.
CURRENCY_WORDS = (
    ("PLN", r"zł|\b(?:zl|zloty|zlotych|złoty|złote|złotych)\b"),
    ("EUR", r"€|\beuro\b"),
    ("GBP", r"£|\b(?:pound|pounds|funt|funty|funtów)\b"),
    ("USD", r"\b(?:dollar|dollars|dolar|dolary|dolarów)\b"),
)
#: What names a format of units. Fixed values.
UNIT_FORMATS = (
    r"\bsingle[\s-]?unit\b",
    r"\bmulti[\s-]?unit\b",
    r"\barea[\s-]?development\b",
    r"\bmaster[\s-]?franchi[sz]e\b",
    r"\bsub[\s-]?franchi[sz]e\b",
    r"\bone[\s-]+store\b",
    r"\bmultiple[\s-]+stores?\b",
    r"\bnew[\s-]+(?:unit|store)\b",
    r"\bexisting[\s-]+store\b",
    r"\brenewal\b",
    r"\btransfer\b",
    r"\bresale\b",
    r"\bpojedyncz\w*[\s-]+sklep\w*\b",
    r"\bjed(?:en|nego)[\s-]+sklep\w*\b",
    r"\bkilk\w*[\s-]+sklep\w*\b",
    r"\bwiel\w*[\s-]+sklep\w*\b",
    r"\bmulti[\s-]?franczy\w*\b",
    r"\bfranczy\w*[\s-]+master\b",
    r"\bmaster[\s-]+franczy\w*\b",
    r"\bsubfranczy\w*\b",
    r"\bobszar\w*[\s-]+rozwoj\w*\b",
    r"\bnow\w*[\s-]+sklep\w*\b",
    r"\bistniej\w*[\s-]+sklep\w*\b",
    r"\bodsprzeda\w*\b",
    r"\bprzej[eę]ci\w*\b",
    r"\bcesj\w*\b",
    r"\bodnowieni\w*\b",
    r"\bprzedłużeni\w*\b",
)
#: Words of promotional pages' paths, and of tasks that are about promotion. Fixed values.
PROMOTION_PATHS = ("contest", "giveaway", "konkurs", "loteria", "plakat", "sweepstakes")
PROMOTION_TASKS = ("advertising", "campaign", "contest", "kampania", "konkurs", "marketing", "promotion", "promocj", "reklam")
#: Host labels of government. Fixed values.
GOVERNMENT = ("admin", "court", "europa", "gouv", "government", "gov", "justice", "state")
#: Notes that mark a lead, and notes and paths that mark a draft of a law. Fixed values.
LEAD_NOTES = ("aggregat", "routing lead", "third-party", "third party")
DRAFT_NOTES = ("draft law", "legislative project", "legislative-project", "projekt ustawy", "proposed law")
DRAFT_PATHS = ("draft-bill", "projekt-ustawy", "proposed-law")
#: Failures of a provider that a fresh request can mend. Fixed values.
TRANSIENT = {
    "InternalServerError": "provider_server_error",
    "APITimeoutError": "timeout",
    "RateLimitError": "rate_limit",
    "APIConnectionError": "connection_error",
    "ServiceUnavailableError": "provider_server_error",
}
#: Stable codes of a provider's exceptions; others are provider_exception. Fixed values.
EXCEPTIONS = {
    "RateLimitError": "rate_limit",
    "APITimeoutError": "timeout",
    "AuthenticationError": "authentication_error",
    "PermissionDeniedError": "permission_denied",
    "BadRequestError": "invalid_request",
    "InternalServerError": "provider_server_error",
    "APIConnectionError": "connection_error",
    "APIStatusError": "provider_status_error",
}
#: What inherited notes begin with. Fixed value.
INHERITED = "Inherited from exact predecessor Searcher artifact. "
_WORDS = r"([a-z0-9ąćęłńóśźż]+)"


def currency(code: Column, value: Column) -> Column:
    """ISO code of the first of two texts that tells one without doubt; null where neither does."""

    def one(text: Column) -> Column:
        low = F.lower(F.btrim(text))
        codes = F.array_intersect(F.transform(F.regexp_extract_all(low, F.lit("([a-z]{3})"), F.lit(1)), F.upper), F.array(*map(F.lit, CURRENCIES)))
        out = F.when(F.size(codes) == 1, codes[0])
        for name, words in CURRENCY_WORDS:
            out = out.when(low.rlike(f"(?U){words}"), name)
        return out

    return F.coalesce(one(code), one(value))


def is_unit_format(value: Column) -> Column:
    """The value names a format of units."""
    return F.regexp_replace(value, r"\s+", " ").rlike("(?iU)" + "|".join(UNIT_FORMATS))


def has_digit(value: Column) -> Column:
    """The value may be a quantity."""
    return value.rlike(r"\d")


def display(kind: Column, text: Column, low: Column, high: Column, unit: Column, yes: Column) -> Column:
    """A typed value for people: ``low – high unit``, Tak or Nie, else its text."""
    low, high = F.coalesce(low, F.lit("")), F.coalesce(high, F.lit(""))
    span = F.when((high == "") | (high == low), low).otherwise(F.concat(low, F.lit(" – "), high))
    suffix = F.coalesce(unit, F.when(kind == "percentage", "%"), F.lit(""))
    number = F.btrim(F.concat(span, F.lit(" "), suffix))
    yes_no = F.when(yes, "Tak").otherwise("Nie")
    return F.when(kind.isin("integer", "decimal", "money", "percentage"), number).when(kind == "boolean", yes_no).otherwise(text)


def _has(words: Column, marks) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, marks)))


def unrelated_promotion(url: Column, task: Column) -> Column:
    """A promotional page that the task didn't ask for."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(_WORDS), F.lit(1))
    return _has(words(web.part(url, 5)), PROMOTION_PATHS) & ~_has(words(task), PROMOTION_TASKS)


def refined_type(kind: Column, note: Column, url: Column) -> Column:
    """A registry off government hosts is but a lead; a law that is still a draft is a project."""
    low, labels = F.lower(note), F.split(web.host(url), r"\.")
    any_of = lambda c, marks: c.rlike("|".join(marks))
    lead = (kind == "registry") & (any_of(low, LEAD_NOTES) | ((url != "") & ~_has(labels, GOVERNMENT)))
    draft = kind.isin("government", "legal_document") & (any_of(low, DRAFT_NOTES) | any_of(F.lower(web.part(url, 5)), DRAFT_PATHS))
    return F.when(lead, "routing_lead").when(draft, "legislative_project").otherwise(kind)


def authority_type(url: Column) -> Column:
    """What the host of an authority says about a source."""
    labels = F.split(web.host(url), r"\.")
    return (
        F.when(_has(labels, ["imsig"]), "routing_lead")
        .when(_has(labels, ["uokik", "uodo"]), "regulator")
        .when(_has(labels, ["isap", "sejm", "eli"]), "legal_document")
        .otherwise("unknown")
    )


def transient_code(log: Column, tail: int = 100_000) -> Column:
    """Stable code of a failure that a retry can mend, from the end of a log; null for others and for none."""
    log = F.right(log, F.lit(tail))
    named = F.regexp_extract(log, r"request failed \(([A-Za-z0-9_]+)\)", 1)
    codes = F.create_map(*[F.lit(x) for pair in TRANSIENT.items() for x in pair])
    low, told = F.lower(log), F.when(F.lit(False), "")
    for code in ("provider_server_error", "timeout", "rate_limit", "connection_error"):
        told = told.when(low.contains(f'error_code": "{code}') | low.contains(f"with {code}"), code)
    return F.when(named != "", F.try_element_at(codes, named)).otherwise(told)


def exception_code(name: Column) -> Column:
    """Stable code of an exception by its class."""
    codes = F.create_map(*[F.lit(x) for pair in EXCEPTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, name), F.lit("provider_exception"))


def ledger_paths(log: Column, tail: int = 100_000) -> Column:
    """Distinct ledgers of attempts that a log names, in order."""
    lists = F.regexp_extract_all(F.right(log, F.lit(tail)), F.lit(r"(?:Failure ledger|Provider usage saved to):\s*([^\n]+)"), F.lit(1))
    paths = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda p: F.rtrim(F.btrim(p), F.lit(".")))
    return F.array_distinct(F.filter(paths, lambda p: p.rlike(r"(^|/)attempts/[^/]+\.json$")))


def inherited_note(note: Column, most: int = 1000) -> Column:
    """The note with the mark of inheritance once before it, cut to ``most`` characters."""
    bare = F.regexp_replace(note, "^(?:" + INHERITED.replace(".", r"\.") + ")+", "")
    return F.substring(F.concat(F.lit(INHERITED), bare), 1, most)


def even_places(n: Column, k: Column) -> Column:
    """``k`` places from 0 to ``n - 1``, evenly spread, halves to even."""
    step = F.greatest(k - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (n - 1) / step, 0).cast("bigint"))


@F.pandas_udf(StringType())
def first_object(text: pd.Series) -> pd.Series:
    """The first JSON object that begins at some brace of the text; null where none parses."""
    decoder = json.JSONDecoder()

    def one(value):
        at = value.find("{") if value is not None else -1
        while at >= 0:
            try:
                found, _ = decoder.raw_decode(value, at)
                return json.dumps(found)
            except ValueError:
                at = value.find("{", at + 1)
        return None

    return text.map(one)


def canonical_json(**columns: Column) -> Column:
    """JSON with sorted keys and no blanks, ended by a line feed."""
    return F.concat(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)])), F.lit("\n"))


#: Longest public text of a field; others have 400 characters. Fixed values.
LONGEST = {
    "brand.public_summary": 400,
    "contact.generic_business_route": 240,
    "offer.unit_formats": 240,
    "candidate.premises_requirements": 400,
    "support.training_program": 400,
}


def public_text_issue(target: Column, text: Column, brand: Column) -> Column:
    """Why a field's text may not be shown as it is; null where it may."""
    value = F.regexp_replace(text, r"^\s+|\s+$", "")
    label = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    limits = F.create_map(*[F.lit(x) for pair in LONGEST.items() for x in pair])
    site, name = target.isin("websites.official", "websites.franchise_offer"), target == "brand.name"
    return (
        F.when(F.coalesce(value, F.lit("")) == "", "invalid_public_text")
        .when(value.rlike(r"[\x00\r]"), "invalid_public_text")
        .when(value.contains(" | ") | (F.size(F.split(value, "\n")) > 4), "uncompacted_public_text")
        .when(site & ~value.rlike("^https?://[^/?#]"), "invalid_public_url")
        .when(name & ~F.length(value).between(2, 160), "invalid_brand_name_length")
        .when(name & (label(value) != label(brand)), "brand_name_mismatch")
        .when(~site & ~name & ~F.length(value).between(3, F.coalesce(F.try_element_at(limits, target), F.lit(400))), "invalid_public_text_length")
        .when(~site & ~name & (F.size(F.regexp_extract_all(value, F.lit(r"([.!?]+(?:\s|$))"), F.lit(1))) > 3), "too_many_public_sentences")
    )


NUMERIC = ("integer", "decimal", "money", "percentage")
_DECIMAL = r"^-?(0|[1-9]\d*)(\.\d+)?$"


def typed_issue(v: dict[str, Column]) -> Column:
    """Code of the first rule that a normalized value breaks; null where it keeps all of them.

    ``v`` holds ``task_id, target_field, claim_ids, canonical_text, unit, notes, value_type, precision, number_min,
    number_max, boolean_value, date_value, currency``.
    """
    kind, numeric = v["value_type"], v["value_type"].isin(*NUMERIC)
    low, high = (v[c].try_cast("decimal(38,10)") for c in ("number_min", "number_max"))
    spans = v["number_max"].isNotNull() & (high != low)
    whole = lambda c: c.isNull() | (c == F.floor(c))
    none = lambda *names: ~F.coalesce(*[F.when(v[n].isNotNull(), F.lit(True)) for n in names], F.lit(False))
    bad_number = lambda c: v[c].isNotNull() & ~v[c].rlike(_DECIMAL)
    is_date = F.coalesce(v["date_value"].rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) & v["date_value"].try_cast("date").isNotNull()
    ranged = v["precision"] == "range"
    rules = [
        (F.btrim(v["task_id"]) == "", "blank_task_id"),
        (~F.length(v["target_field"]).between(1, 500), "invalid_target_field"),
        (~F.size(v["claim_ids"]).between(1, 50), "invalid_claim_group_size"),
        (F.size(v["claim_ids"]) != F.size(F.array_distinct(v["claim_ids"])), "duplicate_claim_ids"),
        (~F.length(v["canonical_text"]).between(1, 2000), "invalid_canonical_text"),
        (F.length(v["unit"]) > 100, "invalid_unit"),
        (F.length(v["notes"]) > 1000, "invalid_notes"),
        (bad_number("number_min") | bad_number("number_max"), "invalid_numeric_format"),
        (~v["currency"].rlike("^[A-Z]{3}$"), "invalid_currency"),
        (numeric & ~(v["number_min"].isNotNull() & none("boolean_value", "date_value")), "invalid_numeric_value"),
        (numeric & (high < low), "descending_numeric_range"),
        ((kind == "integer") & ~(whole(low) & whole(high)), "non_integral_integer"),
        ((kind == "money") & v["currency"].isNull(), "missing_money_currency"),
        (numeric & (kind != "money") & v["currency"].isNotNull(), "unexpected_currency"),
        (numeric & spans & ~ranged, "invalid_range_precision"),
        ((kind == "boolean") & ~(v["boolean_value"].isNotNull() & none("number_min", "number_max", "date_value", "currency")), "invalid_boolean_value"),
        ((kind == "date") & ~(is_date & none("number_min", "number_max", "boolean_value", "currency")), "invalid_date_value"),
        (~numeric & ~kind.isin("boolean", "date") & ~none("number_min", "number_max", "boolean_value", "date_value", "currency"), "unexpected_typed_value"),
        ((kind == "url") & ~v["canonical_text"].rlike(r"^https?://\S+$"), "invalid_url_value"),
        (ranged & ~(numeric & F.coalesce(spans, F.lit(False))), "invalid_range_precision"),
    ]
    out = F.when(F.lit(False), "")
    for broken, code in rules:
        out = out.when(broken, code)
    return out


def typed_column(kind: Column, text: Column, currency: Column) -> Column:
    """Struct of a profile's value by its column's kind: ``flag, number, whole, text``, and the ``issue`` that keeps it out."""
    raw = F.btrim(text)
    number = F.replace(F.replace(raw, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(18,2)")
    flag = F.when(F.lower(raw).isin("true", "tak", "yes", "1"), True).when(F.lower(raw).isin("false", "nie", "no", "0"), False)
    money = ~F.coalesce(F.upper(F.btrim(currency)), F.lit("")).isin("", "PLN")
    issue = (
        F.when((kind == "boolean") & flag.isNull(), "invalid_boolean_value")
        .when((kind == "money") & money, "unsupported_currency")
        .when(kind.isin("decimal", "money", "integer") & number.isNull(), "invalid_profile_value")
        .when((kind == "integer") & (number != F.floor(number)), "non_integral_value")
        .when((kind == "url") & ~raw.rlike(r"^https?://[^\s/.]+(\.[^\s/.]+)+(/\S*)?$"), "invalid_profile_value")
    )
    fits = lambda *kinds: kind.isin(*kinds) & issue.isNull()
    return F.struct(
        F.when(fits("boolean"), flag).alias("flag"),
        F.when(fits("decimal", "money"), number).alias("number"),
        F.when(fits("integer"), number.cast("bigint")).alias("whole"),
        F.when(fits("text", "url"), raw).alias("text"),
        issue.alias("issue"),
    )
