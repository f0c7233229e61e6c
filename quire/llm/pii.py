"""Format-preserving pseudonyms for personal data, in SQL expressions only.

Secrets and e-mail addresses are found first. The rest is cut wherever some layout of the other
kinds may begin, and every such place is tried by itself, kind after kind and the longest layout
first, so a match that fails validation hides neither a shorter one nor one that begins inside it.
What passes its kind's validation is replaced by a keyed pseudonym of the same format; what fails
stays as it is.

================  =====================================  ==========================================
kind              validated by                           pseudonym
================  =====================================  ==========================================
card number       13-19 digits, issuer range, Luhn       digits permuted within the issuer ranges,
                                                         check digit recomputed
IBAN              length, checksum modulo 97             digits permuted, checksum recomputed
SSN               area, group and serial ranges          digits permuted within the valid ranges
phone number      8-15 digits, a telephone layout        subscriber digits permuted
date              a calendar date from 1900 to 2099,     another calendar date, same layout
                  dd/MM or else MM/dd
IPv4 address      four octets up to 255                  another address
e-mail address    shape                                  hashed local part and domain
secret            a key name before a long value         letters and digits hashed, same length
================  =====================================  ==========================================

Numbers, addresses and dates go through a Feistel network over Z_a x Z_b with SHA-256 rounds. It
is a bijection of the format's values, so equal values get equal pseudonyms in all documents and
different values of one format different ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import forgetful_parser, fresh_name

#: Half rounds of the Feistel network.
ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31, and the factors of the range they are permuted over.
DAYS, DAY_RANGE = 73_049, (270, 271)
#: Steps at most of a walk along the permutation's cycle to a date in the range and of the wanted layout.
WALK = 64

# Patterns are used by Java's engine; quantifiers are bounded or possessive, so no text makes them
# backtrack far. None holds a single quote.
#: A secret: runs of at least 16 characters, with dots between them as in signed tokens.
VALUE = r"[0-9A-Za-z_+/\-]{16,}+(?:\.[0-9A-Za-z_+/\-]{16,}+)*+"
#: What names of secrets end with; other words may stand before, parted by _ or -.
NAMES = r"(?:access|auth|client|refresh|session|user|app|db)?(?:token|secret|passwd|password|passphrase|pwd|(?:api|access|private|secret)[_-]?key)"
QUOTE = r"[\x22\x27]?"
PATTERNS = {
    "secret": (
        r"(?i:(?<![A-Za-z0-9])(?:(?:[A-Za-z0-9]{1,32}+[_-]){0,6}" + NAMES + QUOTE + r"\s{0,3}[=:]\s{0,3}" + QUOTE
        + "|authorization" + QUOTE + r"\s{0,3}[=:]\s{0,3}" + QUOTE + r"(?:bearer|basic)\s{1,3})" + VALUE + QUOTE + ")"
    ),
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9_%+\-](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9_%+\-])?@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])",
    "date": r"(?<![0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/\-])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9\-])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){2,3}(?:[ \-][0-9]{1,3})?|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9\-])",
}
#: Country codes of one and two digits; all others have three.
CODES = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: A further group of a phone number; one that begins an address, a date, an SSN or a card is none.
GROUP = (
    r"(?:[ .\-](?![0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])|[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])|[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9])"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])|[0-9]{4}(?:[ \-][0-9]{4}){3}(?![0-9]))[0-9]{2,8})"
)
PLUS = r"(?<![0-9+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})"
#: Layouts of a kind, longest first; a number of the North American plan has ten digits after +1.
LAYOUTS = {
    "iban": [PATTERNS["iban"]],  # and those of _ibans
    "ip": [PATTERNS["ip"]],
    "date": [PATTERNS["date"]],
    "ssn": [PATTERNS["ssn"]],
    "phone": [
        r"(?<![0-9+])\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])",
        *(PLUS + GROUP.replace("\\1", "\\2") + "{%d}(?![0-9])" % n for n in (4, 3, 2, 1)),
        r"(?<![0-9+])\+[0-9]{8,15}(?![0-9])",
        r"(?<![0-9+])(?:\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}|[2-9][0-9]{2} [0-9]{3} [0-9]{4})(?![0-9])",
    ],
    "card": [r"(?<![0-9\-])(?:" + p + r")(?![0-9\-])" for p in (
        "[0-9]{13,19}", *(r"[0-9]{4}(?:[ \-][0-9]{4}){3}[ \-][0-9]{%d}(?!/[0-9])" % n for n in (3, 2, 1)), r"[0-9]{4}(?:[ \-][0-9]{4}){3}",
        *(r"[0-9]{4}(?:[ \-][0-9]{4}){2}[ \-][0-9]{%d}" % n for n in (3, 2, 1)), r"[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}",
    )],
}
#: Characters of each country's IBAN.
IBANS = dict(x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 "
    "GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 "
    "NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
).split())
#: Where some layout may begin.
START = "|".join([*(PATTERNS[k] for k in ("iban", "ip", "date", "ssn", "card")), PLUS + r"[ .\-][0-9]{2}", *LAYOUTS["phone"][-2:]])
WORDS = "|".join(PATTERNS[k] for k in ("secret", "email"))
#: Characters seen from a start (no layout is longer), and starts at most in them.
SEEN, STARTS = 80, 40
#: Starts that are put together at once, so that long tables of numbers take time in proportion.
CHUNK = 128


def _lit(text: str) -> str:
    return "r'" + text + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _feistel(left: str, right: str, a: str, b: str, tweak: str, key: str) -> str:
    """SQL struct (l, r): the image of (left, right) in Z_a x Z_b under the keyed permutation."""
    mix = lambda i, x: f"cast(conv(substr(sha2(concat_ws('|', {key}, {tweak}, {i}, {x}), 256), 1, 14), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> "
        f"case when i % 2 = 0 then named_struct('l', (s.l + {mix('i', 's.r')}) % {a}, 'r', s.r) else named_struct('l', s.l, 'r', (s.r + {mix('i', 's.l')}) % {b}) end)"
    )


def _digits(d: str, tweak: str, key: str) -> str:
    """SQL: the digit string ``d`` (a name) permuted among digit strings of its length."""
    half, rest = f"(length({d}) div 2)", f"(length({d}) - length({d}) div 2)"
    ten = lambda n: f"cast(rpad('1', cast({n} as int) + 1, '0') as bigint)"
    left, right = f"concat('0', substr({d}, 1, cast({half} as int)))", f"concat('0', substr({d}, cast({half} as int) + 1))"
    f = _feistel(left, right, ten(half), ten(rest), f"concat({tweak}, length({d}))", key)
    padded = lambda x, n: f"case when {n} = 0 then '' else lpad(cast({x} as string), cast({n} as int), '0') end"
    return _let("f", f, f"concat({padded('f.l', half)}, {padded('f.r', rest)})")


def _refill(m: str, d: str) -> str:
    """SQL: ``m`` with its digits replaced, in order, by those of ``d``."""
    place = f"length(regexp_replace(substr({m}, 1, j + 1), r'[^0-9]', ''))"
    return f"array_join(transform(split({m}, ''), (c, j) -> case when c rlike r'^[0-9]$' then substr({d}, {place}, 1) else c end), '')"


def _luhn(d: str) -> str:
    """SQL: Luhn sum of the digit string ``d`` modulo 10."""
    return (
        f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + element_at(array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9), "
        f"1 + cast(substr({d}, i, 1) as int) + case when (length({d}) - i) % 2 = 1 then 10 else 0 end)) % 10"
    )


def _mod97(s: str) -> str:
    """SQL: the number that ``s`` spells (A = 10 ... Z = 35) modulo 97."""
    return (
        f"aggregate(split({s}, ''), 0, (t, c) -> case when c rlike r'^[0-9]$' then (t * 10 + cast(c as int)) % 97 when c rlike r'^[A-Z]$' then (t * 100 + ascii(c) - 55) % 97 else t end)"
    )


#: How numbers of the known card networks begin.
ISSUERS = "^(?:4|5[0-9]|6|3[4-9]|30|222[1-9]|22[3-9]|2[3-6]|27[01]|2720)"


def _card(key: str) -> str:
    """The first digit names the network and stays, the last is the check digit; what is between is permuted until an issuer range is met again."""
    valid = f"(x.d rlike r'{ISSUERS}' and length(x.d) between 13 and 19 and {_luhn('x.d')} = 0)"
    step = _let("q", "u.b", _digits("q", "'card'", key))
    # at least half of the numbers of each network are in its ranges, so WALK steps leave no value without an end
    walked = f"aggregate(sequence(1, {WALK}), named_struct('b', substr(x.d, 2, length(x.d) - 2), 'done', false), (u, e) -> case when u.done then u else {_let('y', step, f'named_struct(\'b\', y, \'done\', concat(substr(x.d, 1, 1), y) rlike r\'{ISSUERS}\')')} end)"
    new = _let("p", f"concat(substr(x.d, 1, 1), ({walked}).b)", _let("z", "concat(p, '0')", f"concat(p, cast((10 - {_luhn('z')}) % 10 as string))"))
    return f"case when {valid} then {_let('n', new, _refill('x.m', 'n'))} end"


def _iban(key: str) -> str:
    return _let(
        "b",
        "replace(x.m, ' ', '')",
        "case when length(b) between 15 and 34 and " + _mod97("concat(substr(b, 5), substr(b, 1, 4))") + " = 1 then "
        + _let(
            "bban",
            _let("d", "regexp_replace(substr(b, 5), r'[^0-9]', '')", f"case when d = '' then substr(b, 5) else {_let('n', _digits('d', "concat('iban', substr(b, 1, 2))", key), _refill('substr(b, 5)', 'n'))} end"),
            _let(
                "whole",
                "concat(substr(b, 1, 2), lpad(cast(98 - " + _mod97("concat(bban, substr(b, 1, 2), '00')") + " as string), 2, '0'), bban)",
                # spaces come back where they were
                "array_join(transform(split(x.m, ''), (c, j) -> case when c = ' ' then c else substr(whole, length(replace(substr(x.m, 1, j + 1), ' ', '')), 1) end), '')",
            ),
        )
        + " end",
    )


def _ssn(key: str) -> str:
    # areas 1-899 without 666 are 898 values, groups 1-99, serials 1-9999: (area, group) x serial
    area = "cast(substr(x.d, 1, 3) as int)"
    valid = f"({area} between 1 and 899 and {area} <> 666 and substr(x.d, 4, 2) <> '00' and substr(x.d, 6) <> '0000')"
    left = f"(({area} - 1 - case when {area} > 666 then 1 else 0 end) * 99 + cast(substr(x.d, 4, 2) as int) - 1)"
    f = _feistel(left, "(cast(substr(x.d, 6) as int) - 1)", str(898 * 99), "9999", "'ssn'", key)
    new = "concat_ws('-', lpad(cast(f.l div 99 + 1 + case when f.l div 99 >= 665 then 1 else 0 end as string), 3, '0'), lpad(cast(f.l % 99 + 1 as string), 2, '0'), lpad(cast(f.r + 1 as string), 4, '0'))"
    return f"case when {valid} then {_let('f', f, new)} end"


def _phone(key: str) -> str:
    # the country code after "+" stays
    head = f"regexp_extract(x.m, {_lit(r'^(\+[0-9]{1,3}[ .\-]|\+(?:' + CODES + '|[0-9]{3})|)')}, 1)"
    return (
        "case when length(x.d) between 8 and 15 then "
        + _let("h", head, _let("t", "substr(x.m, length(h) + 1)", _let("d", "regexp_replace(t, r'[^0-9]', '')", _let("n", _digits("d", "'phone'", key), f"concat(h, {_refill('t', 'n')})"))))
        + " end"
    )


def _date(key: str) -> str:
    """Slashed dates are dd/MM where that is a date, else MM/dd; both are permuted among their like by walking the cycle."""
    a, b = DAY_RANGE
    parsed = "case when x.m like '____-__-__' then try_to_timestamp(x.m, 'yyyy-MM-dd') when x.m like '__.__.____' then try_to_timestamp(x.m, 'dd.MM.yyyy') else coalesce(try_to_timestamp(x.m, 'dd/MM/yyyy'), try_to_timestamp(x.m, 'MM/dd/yyyy')) end"
    back = "case when x.m like '____-__-__' then date_format(n, 'yyyy-MM-dd') when x.m like '__.__.____' then date_format(n, 'dd.MM.yyyy') when us then date_format(n, 'MM/dd/yyyy') else date_format(n, 'dd/MM/yyyy') end"
    us = "(x.m like '__/__/____' and try_to_timestamp(x.m, 'dd/MM/yyyy') is null)"
    step = _let("f", _feistel(f"(w.k div {b})", f"(w.k % {b})", str(a), str(b), "'date'", key), f"f.l * {b} + f.r")
    ok = f"y < {DAYS} and (not us or day(date_add(date'1900-01-01', cast(y as int))) > 12)"
    # one step fails at most four times in ten, so WALK of them leave no value without an end
    walked = f"aggregate(sequence(1, {WALK}), named_struct('k', cast(k as bigint), 'done', false), (w, i) -> case when w.done then w else {_let('y', step, f'named_struct(\'k\', y, \'done\', {ok})')} end)"
    shifted = _let("n", f"date_add(date'1900-01-01', cast({walked}.k as int))", back)
    return _let("us", us, _let("k", f"datediff(cast({parsed} as date), date'1900-01-01')", f"case when k between 0 and {DAYS - 1} then {shifted} end"))


def _ip(key: str) -> str:
    octet = lambda i: f"cast(element_at(o, {i}) as int)"
    f = _feistel(f"({octet(1)} * 256 + {octet(2)})", f"({octet(3)} * 256 + {octet(4)})", "65536", "65536", "'ip'", key)
    return _let("o", r"split(x.m, r'\.')", f"case when forall(o, v -> cast(v as int) <= 255) then {_let('f', f, "concat_ws('.', f.l div 256, f.l % 256, f.r div 256, f.r % 256)")} end")


def _email(key: str) -> str:
    return f"concat('u', substr(sha2(concat_ws('|', {key}, 'local', lower(substring_index(x.m, '@', 1))), 256), 1, 12), '@d', substr(sha2(concat_ws('|', {key}, 'domain', lower(substring_index(x.m, '@', -1))), 256), 1, 10), '.example')"


def _secret(key: str) -> str:
    value = _lit(r"(?:[=:]\s{0,3}" + QUOTE + r"|(?i:bearer|basic)\s{1,3})(" + VALUE + ")" + QUOTE + "$")
    # the first hashes are those of values of 256 characters at most
    stream = f"array_join(transform(sequence(0, greatest(3, (length(v) - 1) div 64)), i -> sha2(concat_ws('|', {key}, 'secret', i, h), 256)), '')"
    hashed = _let("h", "case when length(v) <= 256 then v else sha2(v, 256) end", f"substr({stream}, 1, length(v))")
    end = _lit(QUOTE.removesuffix("?") + "$")
    return _let("v", f"regexp_extract(x.m, {value}, 1)", _let("q", f"regexp_substr(x.m, {end})", f"concat(substr(x.m, 1, length(x.m) - length(v) - coalesce(length(q), 0)), {hashed}, coalesce(q, ''))"))


KINDS = {"iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _word(key: str) -> str:
    """SQL struct (kind, old, new) for a secret or an e-mail address ``m``."""
    secret = f"m rlike {_lit('^(?:' + PATTERNS['secret'] + ')$')}"
    return _let("x", "named_struct('m', m)", f"case when {secret} then named_struct('kind', 'secret', 'old', m, 'new', {_secret(key)}) else named_struct('kind', 'email', 'old', m, 'new', {_email(key)}) end")


def _ibans() -> str:
    """SQL array: IBANs of their country's length at the second character of ``w``; without a known country those of any length."""
    known = "map(" + ", ".join(f"'{c}', {n}" for c, n in IBANS.items()) + ")"
    tail = "case when n % 4 > 0 then concat(' [A-Z0-9]{', n % 4, '}') else '' end"
    layout = f"concat({_lit('(?s)^.((?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{')}, n - 4, {_lit('}|(?: [A-Z0-9]{4}){')}, n div 4 - 1, '}}', {tail}, {_lit('))(?![A-Za-z0-9])')})"
    lengths = _let("c", f"element_at({known}, substr(w, 2, 2))", "case when c is null then sequence(34, 15, -1) else array(c) end")
    return f"case when w rlike {_lit('(?s)^.[A-Z]{2}[0-9]{2}')} then transform({lengths}, n -> regexp_extract(w, {layout}, 1)) else array() end"


def _matches(kind: str) -> str:
    """SQL array: what the layouts of ``kind`` match at the second character of ``w``, or empty strings."""
    found = "array(" + ", ".join(f"regexp_extract(w, {_lit('(?s)^.(' + p + ')')}, 1)" for p in LAYOUTS[kind]) + ")"
    return f"concat({_ibans()}, {found})" if kind == "iban" else found


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parsed_with(value: Column, name: str, body: str) -> Column:
    """SQL ``body``, which names nothing but ``name``, with ``value`` for it, computed once.

    A text of its own: what the parser needs for a text grows faster than its length.
    """
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), 1)


def _number(w: Column, key: str) -> Column:
    """Struct (kind, old, new) for the first valid value at the second character of ``w``, or null."""
    hits = []
    for kind, f in KINDS.items():
        found = _let("x", "named_struct('m', m, 'd', regexp_replace(m, r'[^0-9]', ''))", f"named_struct('kind', '{kind}', 'old', m, 'new', {f(key)})")
        hits.append(_parsed_with(w, "w", f"get(filter(transform(filter({_matches(kind)}, m -> m <> ''), m -> {found}), h -> h.new is not null), 0)"))
    return F.when(w.rlike("(?s)^.(?:" + START + ")"), F.coalesce(*hits))


def _numbers(g: Column, key: str) -> Column:
    """Array of structs (text, hit): the text ``g`` with its numbers, addresses and dates replaced, in parts."""

    def window(p: Column, i: Column) -> Column:
        ahead = F.array_join(F.transform(F.slice(p, i + 1, STARTS), lambda q: F.substring(q, 1, SEEN)), "")
        return F.concat(F.when(i == 0, "\n").otherwise(F.right(p[i - 1], F.lit(1))), F.substring(ahead, 1, SEEN))

    def tried(p: Column) -> Column:
        return F.transform(p, lambda q, i: F.struct(q.alias("q"), _with(window(p, i), lambda w: _number(w, key)).alias("h")))

    # a part that a value found before covers is dropped as far as it is covered; values don't begin inside others
    free = "named_struct('skip', greatest(length(c.h.old) - length(c.q), 0), 'out', concat(s.out, array(named_struct('text', concat(c.h.new, substr(c.q, length(c.h.old) + 1)), 'hit', c.h))))"
    plain = "named_struct('skip', greatest(s.skip - length(c.q), 0), 'out', concat(s.out, array(named_struct('text', substr(c.q, s.skip + 1), 'hit', cast(null as struct<kind: string, old: string, new: string>)))))"
    none = "cast(array() as array<struct<text: string, hit: struct<kind: string, old: string, new: string>>>)"
    step = f"case when s.skip = 0 and c.h is not null then {free} else {plain} end"
    chunk = f"aggregate(slice(t, k * {CHUNK} + 1, {CHUNK}), named_struct('skip', a.skip, 'out', {none}), (s, c) -> {step})"
    whole = f"aggregate(sequence(0, (size(t) - 1) div {CHUNK}), named_struct('skip', 0, 'out', cast(array() as array<array<struct<text: string, hit: struct<kind: string, old: string, new: string>>>>)), (a, k) -> {_let('o', chunk, 'named_struct(\'skip\', o.skip, \'out\', concat(a.out, array(o.out)))')})"
    replaced = _with(F.split(g, "(?=" + START + ")", -1), lambda p: _parsed_with(tried(p), "t", f"flatten(({whole}).out)"))
    untouched = F.array(F.struct(g.alias("text"), F.lit(None).cast("struct<kind: string, old: string, new: string>").alias("hit")))
    return F.when(g.rlike(START), replaced).otherwise(untouched)


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` pseudonymised, ``n_pii`` (replacements) and ``pii_kinds`` (their kinds, in text order).

    Rows stay one to one, whatever repeats. Null text stays null with 0 replacements and no kinds;
    an empty or clean text is returned as it is. Columns named n_pii or pii_kinds are replaced; all
    others stay, whatever their names. Whoever has the ``key`` can invert the permutations. It is a
    literal of the plan: let spark.sql.redaction.string.regex match it where plans are logged.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    if "'" in key or "\\" in key:
        raise ValueError("the key may hold neither quotes nor backslashes")
    k = f"'{key}'"
    parts = fresh_name(docs, "parts")
    any_pii = F.col(text).rlike("[0-9@]|(?i:token|secret|passw|passp|pwd|key|authorization)") & F.col(text).rlike(WORDS + "|" + START)
    kept = docs.drop("n_pii", "pii_kinds")
    column = F.col(f"`{text}`")
    words = F.call_function("transform", F.regexp_extract_all(column, F.lit(WORDS), F.lit(0)), F.expr(f"m -> {_word(k)}"))
    word = lambda v, i: F.transform(F.slice(v, i + 1, 1), lambda h: F.struct(h["new"].alias("text"), h.alias("hit")))
    cut = _with(words, lambda v: F.flatten(F.transform(F.split(column, WORDS, -1), lambda g, i: F.concat(_numbers(g, k), word(v, i)))))
    with forgetful_parser(docs.sparkSession):
        out = kept.withColumn(parts, F.when(any_pii, cut))
    joined = F.expr(f"array_join(transform({parts}, h -> h.text), '')")
    changed = F.expr(f"filter({parts}, h -> h.hit is not null and h.hit.new <> h.hit.old)")
    columns = [F.coalesce(joined, F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in kept.columns]
    return out.select(
        *columns,
        F.coalesce(F.size(F.when(F.col(parts).isNotNull(), changed)), F.lit(0)).cast("long").alias("n_pii"),
        F.coalesce(F.transform(F.when(F.col(parts).isNotNull(), changed), lambda h: h["hit"]["kind"]), F.array().cast("array<string>")).alias("pii_kinds"),
    )
