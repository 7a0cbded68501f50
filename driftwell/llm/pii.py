"""Personal data and secrets in texts: patterns propose spans, checks confirm them, nearby words adjust the score.

Kinds whose form says little by itself (numbers like social security numbers, long mixed strings like keys) start below
LEAST and count only where a word nearby speaks for them; spans of the base kinds stay whatever their score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns, by kind in the order of results.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Added by this operator.
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
SECRET = r"-----BEGIN [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/_-]{20,}"
#: How the keys of well-known services begin.
KEY_PREFIXES = r"-----BEGIN|AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|eyJ"
#: Characters of an IBAN by country, those in use outside the registry included.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _by_country() -> str:
    """IBANs that begin a word, cut to the length of their country, whatever follows; other codes take the longest run, as
    in IBAN."""
    known = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
    return f"(?<![A-Za-z0-9_])(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())}){IBAN})"


#: The base patterns for Java's engine: equal matches, but a failing run of characters is not tried again from its middle.
LINEAR = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PHONE,
    "iban": _by_country(),
    "ssn": SSN,
    "secret": r"-----BEGIN [A-Z ]*PRIVATE KEY-----|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
}
#: Kinds whose matches may overlap: each place is tried, and of the confirmed spans the leftmost stay.
OVERLAPPING = ("iban",)
#: What a text needs for a kind to occur in it.
HINTS = {
    "email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": "+",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11}", "ssn": SSN,
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20}|-----BEGIN ",
}
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
#: Score of a confirmed span, and what a context word within WINDOW characters adds to it.
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.7, 0.3), "phone": (0.6, 0.3), "iban": (0.8, 0.2), "ssn": (0.3, 0.5), "secret": (0.3, 0.5)}
#: Score of a secret that begins as the keys of a well-known service do.
KNOWN_KEY = 0.9
CONTEXT = {
    "email": "mail|contact|address", "ip": "ip|host|server|address|login", "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|whatsapp", "iban": "iban|bank|account|konto|compte|cuenta", "ssn": "ssn|social security",
    "secret": "token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|bearer",
}
WINDOW = 40
#: Added kinds need this score; spans of the base kinds stay whatever their score.
LEAST = 0.5
_EMPTY = "array<struct<start:bigint,stop:bigint,value:string>>"
_CHUNK = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(lengths: Column, first: Column, n: Column) -> Column:
    return F.aggregate(F.slice(lengths, first, n), F.lit(0).cast("long"), lambda a, x: a + x)


def matches(text: Column, pattern: str, overlapping: bool = False) -> Column:
    """Leftmost non-overlapping matches as ``start, stop, value`` in code points, stop exclusive; with ``overlapping``
    the match at every place that has one.

    The pieces between matches and the matches themselves are measured; places are sums of these lengths, taken in
    chunks so that a text of very many matches costs little more than its length.
    """
    if overlapping:
        # The text is cut before each match; a match at its start leaves no piece, so an empty one is put there.
        cut = F.struct(F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), F.lit(1)).alias("m"), F.split(text, f"(?={pattern})", -1).alias("g"))
        found = _let(cut, lambda s: F.struct(s["m"].alias("m"), F.when(F.size(s["g"]) == F.size(s["m"]), F.concat(F.array(F.lit("")), s["g"])).otherwise(s["g"]).alias("g")))
    else:
        found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def places(s: Column) -> Column:
        step = F.transform(s["m"], lambda x, i: (F.length(F.get(s["g"], i)) + (F.lit(0) if overlapping else F.length(x))).cast("long"))
        return _let(step, lambda steps: _let(
            F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / _CHUNK).cast("int")), lambda c: _total(steps, c * _CHUNK + 1, F.lit(_CHUNK))),
            lambda sums: F.transform(s["m"], lambda x, i: _let(
                _total(sums, F.lit(1), F.floor(i / _CHUNK).cast("int")) + _total(steps, F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK) + F.length(F.get(s["g"], i)),
                lambda start: F.struct(start.alias("start"), (start + F.length(x)).alias("stop"), x.alias("value")),
            )),
        ))

    return _let(found, places)


def apart(spans: Column) -> Column:
    """Of spans in the order of their places those that start where no earlier one that stays is left open."""
    def add(kept: Column, s: Column) -> Column:
        return F.when((F.size(kept) == 0) | (s["start"] >= F.get(kept, F.size(kept) - 1)["stop"]), F.concat(kept, F.array(s))).otherwise(kept)

    return F.aggregate(spans, F.array().cast(_EMPTY), add)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right Luhn check digit."""
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        double = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, double).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether a compact IBAN leaves the remainder 1."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    """The check of a kind on a matched string."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return _let(F.translate(value, " -", ""), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return _let(F.translate(value, " ", ""), lambda c: F.when(F.length(c).between(15, 34), mod97(c)).otherwise(False))
    if kind == "secret":
        return value.rlike(r"^-----BEGIN|[0-9]") & value.rlike("[A-Za-z]")
    if kind == "ssn":
        return ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """``array<struct<kind, start, stop, score>>`` of one kind in a text that is not null."""
    hint = HINTS[kind]
    may = F.contains(text, F.lit(hint)) if len(hint) == 1 else text.rlike(hint)
    good = F.filter(matches(text, LINEAR[kind], kind in OVERLAPPING), lambda s: confirmed(kind, s["value"]))
    found = F.when(may, apart(good) if kind in OVERLAPPING else good).otherwise(F.array().cast(_EMPTY))
    base, more = SCORES[kind]

    def scored(s: Column) -> Column:
        around = F.lower(F.concat(
            F.substring(text, F.greatest(s["start"] - WINDOW + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(WINDOW)).cast("int")),
            F.lit(" "), F.substring(text, (s["stop"] + 1).cast("int"), F.lit(WINDOW)),
        ))
        first = F.lit(base) if kind != "secret" else F.when(s["value"].rlike(f"^(?:{KEY_PREFIXES})"), KNOWN_KEY).otherwise(base)
        score = first + F.when(around.rlike(rf"(?:^|[^a-z])(?:{CONTEXT[kind]})"), more).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), F.round(F.least(score, F.lit(1.0)), 3).alias("score"))

    out = F.transform(found, scored)
    return out if kind in BASE else F.filter(out, lambda s: s["score"] >= LEAST)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row: ``kind, start, stop, score`` by kind (email, ip, card, phone, iban, ssn, secret),
    then start, in code points.

    Null and empty texts have none.  Rows are treated one by one, so repeated rows, null ids, ties and other columns
    have no effect on each other; an empty table gives none.  Texts may be of any length and hold any number of spans.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.select("doc_id", F.concat(*(spans_of(F.col("text"), k) for k in KINDS)).alias("spans"))


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, all spans as a string, ``n_added`` (spans of the added kinds),
    ``top_score`` (the largest score, 0 without spans) and ``flagged`` (whether a span scores LEAST or more)."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *(count(k) for k in BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["kind"].isin(*BASE))).cast("long").alias("n_added"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
        F.exists("spans", lambda s: s["score"] >= LEAST).alias("flagged"),
    )


def _oracle() -> str:
    def kind(name: str, pattern: str, good: str) -> str:
        return f"""
  select doc_id, '{name}' as kind, {KINDS.index(name)} as k, s.a as a, s.a + length(s.v) as b, s.v as v, t from (
    select doc_id, t, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'v': m[i], 'a': list_sum(list_transform(g[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)}})) as s
    from (select doc_id, t, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as g from d)
  ) where {good}"""

    digits = r"regexp_replace(s.v, '[^0-9]', '', 'g')"
    luhn_sql = f"""length({digits}) between 13 and 19 and list_sum(list_transform(range(1, length({digits}) + 1), lambda i:
      case when i % 2 = 0 then 2 * substr(reverse({digits}), i, 1)::int - case when substr(reverse({digits}), i, 1)::int > 4 then 9 else 0 end
      else substr(reverse({digits}), i, 1)::int end)) % 10 = 0"""
    turned = "(substr(replace(s.v, ' ', ''), 5) || substr(replace(s.v, ' ', ''), 1, 4))"
    letters = f"list_transform(range(1, length({turned}) + 1), lambda i: case when ord(substr({turned}, i, 1)) < 58 then ord(substr({turned}, i, 1)) - 48 else ord(substr({turned}, i, 1)) - 55 end)"
    mod_sql = f"list_reduce(list_prepend(0, {letters}), lambda r, x: (r * case when x > 9 then 100 else 10 end + x) % 97) = 1"
    near = lambda name: f"regexp_matches(lower(substr(t, greatest(a - {WINDOW} + 1, 1)::int, least(a, {WINDOW})::int) || ' ' || substr(t, (b + 1)::int, {WINDOW})), '(?:^|[^a-z])(?:{CONTEXT[name]})')"
    parts = [
        kind("email", EMAIL, "true"),
        kind("ip", IP, r"len(list_filter(string_split(s.v, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(ltrim(p, '0') as int), 0) > 255)) = 0"),
        kind("card", CARD, luhn_sql),
        kind("phone", PHONE, f"length({digits}) between 9 and 15"),
        kind("iban", r"\b" + IBAN, f"length(replace(s.v, ' ', '')) between 15 and 34 and {mod_sql}"),
        kind("ssn", SSN, "not regexp_matches(s.v, '^(?:000|666|9)|-00-|-0000$')"),
        kind("secret", SECRET, "regexp_matches(s.v, '^-----BEGIN|[0-9]') and regexp_matches(s.v, '[A-Za-z]')"),
    ]
    scores = " ".join(f"when kind = '{k}' then {f'case when regexp_matches(v, {chr(39)}^(?:{KEY_PREFIXES}){chr(39)}) then {KNOWN_KEY} else {a} end' if k == 'secret' else a} + case when {near(k)} then {b} else 0 end" for k, (a, b) in SCORES.items())
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents), f as ({' union all '.join(parts)}
), kept as (
  select * from (select *, round(least((case {scores} end)::double, 1.0), 3) as score from f) where k < {len(BASE)} or score >= {LEAST}
), g as (
  select doc_id, count(*) filter (where kind = 'email') as n_email, count(*) filter (where kind = 'ip') as n_ip,
    count(*) filter (where kind = 'card') as n_card, count(*) filter (where kind = 'phone') as n_phone,
    string_agg(kind || ':' || a::bigint || ':' || b::bigint, ',' order by k, a) filter (where k < {len(BASE)}) as base,
    string_agg(kind || ':' || a::bigint || ':' || b::bigint, ',' order by k, a) as spans,
    count(*) filter (where k >= {len(BASE)}) as n_added, max(score) as top_score
  from kept group by doc_id
)
select d.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_added, 0) as n_added, coalesce(top_score, 0)::double as top_score, coalesce(top_score >= {LEAST}, false) as flagged
from d left join g using (doc_id)
"""


ORACLE = _oracle()
