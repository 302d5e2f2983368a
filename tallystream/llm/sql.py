"""SQL counterparts of the operators that SQL can express; written for DuckDB, independent of the operators."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def quality_rules_steps(table: str) -> str:
    """CTEs that end in `verdicts`: every row of `table` with its counts, base_failed, kept and level."""
    return rf"""
numbered as (select row_number() over () as rid, *, coalesce(text, '') as t from {table}),
split as (select *, {WORDS.format(t='t')} as words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from numbered),
windows as (select rid, i, array_to_string(words[i:i + 4], ' ') as w
    from (select rid, words, unnest(range(1, len(words) - 3)) as i from split where len(words) >= 5)),
repeated as (select rid, i, lead(i) over (partition by rid order by i) as next
    from (select rid, i, count(*) over (partition by rid, w) as c from windows) where c > 1),
covered as (select rid, sum(least(5, coalesce(next - i, 5)))::bigint as n_repeat_words from repeated group by 1),
counts as (select s.* exclude (words, lines), len(words)::bigint as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines)::bigint as n_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
    from split s left join covered using (rid)),
measures as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    case when word_chars > 0 then 1000 * n_symbols // word_chars else 0 end as symbols_permille,
    case when n_lines > 0 then 1000 * n_dup_lines // n_lines else 0 end as dup_lines_permille,
    case when n_words > 0 then 1000 * n_repeat_words // n_words else 0 end as repeat_permille,
    case when n_words > 0 then 100 * word_chars // n_words else 0 end as word_length_percent from counts),
long as (
    select lang, source, 'symbols' as m, symbols_permille as v from measures where not base_failed union all
    select lang, source, 'dup', dup_lines_permille from measures where not base_failed union all
    select lang, source, 'repeat', repeat_permille from measures where not base_failed union all
    select lang, source, 'length', word_length_percent from measures where not base_failed),
bucketed as (select *, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) as b from long),
ranked as (
    select 'source' as lvl, lang, source, m, b, count(*) as n from bucketed group by all union all
    select 'lang', lang, null, m, b, count(*) from bucketed group by all union all
    select 'all', null, null, m, b, count(*) from bucketed group by all),
cumulated as (select *, sum(n) over (partition by lvl, lang, source, m order by b) as upto,
    sum(n) over (partition by lvl, lang, source, m) as docs from ranked),
quartiles as (select lvl, lang, source, m, docs, min(b) filter (100 * upto >= 25 * docs) as q1,
    min(b) filter (100 * upto >= 75 * docs) as q3 from cumulated group by all),
fences as (select *, q3 + 3 * gap as hi, q1 - 3 * gap as lo from (
    select *, greatest(q3 - q1, case m when 'symbols' then 40 when 'dup' then 100 when 'repeat' then 60 else 100 end)
    as gap from quartiles)),
limits as (select lvl, lang, source, max(docs) as docs, max(hi) filter (m = 'symbols') as sym,
    max(hi) filter (m = 'dup') as dup, max(hi) filter (m = 'repeat') as rep,
    max(hi) filter (m = 'length') as len_hi, max(lo) filter (m = 'length') as len_lo from fences group by 1, 2, 3),
chosen as (select s.lang, s.source,
    case when s.docs >= 50 then 'source' when l.docs >= 50 then 'lang' else 'all' end as level
    from limits s join limits l on l.lvl = 'lang' and s.lang is not distinct from l.lang where s.lvl = 'source'),
verdicts as (select d.*, c.level, not base_failed and coalesce(symbols_permille <= sym and dup_lines_permille <= dup
    and repeat_permille <= rep and word_length_percent <= len_hi and word_length_percent >= len_lo, false) as kept
    from measures d
    left join chosen c on d.lang is not distinct from c.lang and d.source is not distinct from c.source
    left join limits f on f.lvl = c.level
        and (c.level = 'all' or f.lang is not distinct from d.lang)
        and (c.level <> 'source' or f.source is not distinct from d.source))"""


QUALITY_RULES_SQL = f"""with {quality_rules_steps('documents')}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, level from verdicts"""


def mixing_steps(table: str) -> str:
    """CTEs that end in `mix`: every row of `table` with its size, target, copies and taken words."""
    return rf"""
recursive sized as (select row_number() over () as rid, doc_id, source,
    len({WORDS.format(t="coalesce(text, '')")})::bigint as size, md5(coalesce(doc_id::varchar, '')) as key
    from {table}),
sources as (select source, sum(size)::bigint as source_size, count(*) as n,
    [1, 2, 3][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from sized group by 1),
filling as (select *, count(*) over before as k, sum(source_size) over () as total, sum(weight) over () as all_w,
    coalesce(sum(3 * source_size) over before, 0) as full_before, coalesce(sum(weight) over before, 0) as w_before
    from sources window before as (order by source_size / weight, source nulls last
        rows between unbounded preceding and 1 preceding)),
level as (select arg_min((total - full_before)::double / (all_w - w_before)::double, k) filter (
    (total - full_before)::double / (all_w - w_before)::double * weight <= 3 * source_size) as lam from filling),
targets as (select source, source_size, n, weight, case when 3 * source_size < lam * weight
    then (3 * source_size)::double else lam * weight end as target from sources, level),
goals as (select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as passes,
    case when source_size > 0 then floor(target)::bigint % source_size else 0 end as rest from targets),
placed as (select s.*, g.* exclude (source), (('0x' || substr(key, 1, 8))::bigint * ceil(sqrt(n) / 4)::bigint) >> 32 as block
    from sized s join goals g on s.source is not distinct from g.source),
blocks as (select source, block, rest, sum(sum(size)) over (partition by source order by block) - sum(size) as before,
    sum(size) as words from placed group by source, block, rest),
staged as (select p.*, before, case when before + words <= p.rest then 'all' when before < p.rest then 'part'
    else 'none' end as state from placed p join blocks b
    on p.source is not distinct from b.source and p.block = b.block),
queue as (select rid, coalesce(source, chr(0)) as src, size, rest - before as room, row_number() over (
    partition by source order by -size, key, doc_id nulls first) as k from staged where state = 'part'),
filled as (
    select rid, src, k, size <= room and size > 0 as again,
        room - case when size <= room then size else 0 end as room from queue where k = 1
    union all
    select q.rid, q.src, q.k, q.size <= f.room and q.size > 0,
        f.room - case when q.size <= f.room then q.size else 0 end
    from filled f join queue q on q.src = f.src and q.k = f.k + 1),
chosen as (select s.*, coalesce(f.again, state = 'all' and rest > 0) as again,
    [-0.5, 0, 0.5][weight]::double as slope
    from staged s left join filled f using (rid)),
due as (select *, (passes + again::bigint) * (size > 0)::bigint as copies,
    least((before + case when passes > 0 then sum(size) over w else sum(case when again then size else 0 end) over w end
        - size / 2::double) / target, 1::double) as share
    from chosen window w as (partition by source, block order by key, doc_id, size
        rows between unbounded preceding and current row)),
mix as (select *, case when copies > 0 then
    2::double * share / (1::double - slope + sqrt((1::double - slope) * (1::double - slope) + 4::double * slope * share))
    end as position from due)"""


MIXING_SQL = f"""with {mixing_steps('documents')}
select doc_id, size, source_size, target, copies * size as taken, copies, position from mix"""


def _spans_sql(kind: str, pattern: str, keep: str, begin: str = "start") -> str:
    """List of (kind, start, end) of the matches of a pattern that pass a test on `hit` and `before`."""
    return rf"""
{kind}_raw as (select rid, t, regexp_extract_all(t, '{pattern}') as hits from numbered),
{kind}_walk as (
    select rid, t, hits, 1 as i, strpos(t, hits[1]) - 1 as start from {kind}_raw where len(hits) > 0
    union all
    select rid, t, hits, i + 1, start + length(hits[i])
        + strpos(substr(t, (start + length(hits[i]) + 1)::bigint), hits[i + 1]) - 1
    from {kind}_walk where i < len(hits)),
{kind}_at as (select rid, hits[i] as hit, start::bigint as start, (start + length(hits[i]))::bigint as stop,
    lower(substr(t, (greatest(start - 40, 0) + 1)::bigint, least(start, 40)::bigint)) as before,
    case when start > 0 then substr(t, start::bigint, 1) else '' end as left_char,
    substr(t, (start + length(hits[i]) + 1)::bigint, 1) as right_char from {kind}_walk),
{kind}_spans as (select rid, list('{kind}:' || {begin} || ':' || stop order by start) as spans, count(*)::bigint as n
    from {kind}_at where {keep} group by rid)"""


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = rf"""list_sum([case when i % 2 = 0 then substr(reverse({_DIGITS}), i, 1)::int * 2
    - case when substr(reverse({_DIGITS}), i, 1)::int > 4 then 9 else 0 end
    else substr(reverse({_DIGITS}), i, 1)::int end for i in range(1, length({_DIGITS}) + 1)]) % 10 = 0"""
_PLAIN = "replace(hit, ' ', '')"
_TURNED = f"(substr({_PLAIN}, 5) || substr({_PLAIN}, 1, 4))"
_MOD97 = rf"""list_reduce(list_prepend(0, [case when ascii(c) >= 65 then ascii(c) - 55 else ascii(c) - 48 end
    for c in string_split({_TURNED}, '')]),
    lambda r, c: case when c > 9 then (r * 100 + c) % 97 else (r * 10 + c) % 97 end) = 1"""


def _worth(base: str, words: str, against: str, apart: str) -> str:
    """The score of an added kind reaches 50."""
    return rf"""{base} + case when regexp_matches(before, '{words}') then 30 else 0 end
    - case when regexp_matches(before, '{against}') then 30 else 0 end
    - case when regexp_matches(left_char, '{apart}') or regexp_matches(right_char, '{apart}') then 100 else 0 end >= 50"""


_VALUE = "regexp_extract(hit, '[A-Za-z0-9+/_-]+$')"
_SECRET_KEEP = rf"""regexp_matches({_VALUE}, '[0-9]') and regexp_matches({_VALUE}, '[A-Za-z]')
    and length({_VALUE}) * log2(length({_VALUE})::double) - list_sum([k * log2(k::double) for k in
    map_values(list_histogram(string_split({_VALUE}, '')))]) >= 2.9 * length({_VALUE}) and not regexp_matches(right_char, '[A-Za-z0-9+/_-]')
    and regexp_matches(before, 'token|secret|passw|api.?key|access.?key|private.?key|auth|credential|bearer|contraseña|mot de passe|schlüssel')
    and not regexp_matches(before, 'checksum|digest|commit|isbn|serial')"""


def private_sql() -> str:
    """All kinds by their plain patterns; positions by looking for each match behind the previous one.

    The first place of a match's text behind the previous match is the match itself: an earlier one would have
    been found first.
    """
    phone = "phone|tel|call|mobile|fax|cell|telefon|teléfono|téléphone"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
               "list_bool_and([length(ltrim(x, '0')) <= 3 and coalesce(try_cast(ltrim(x, '0') as int), 0) <= 255 "
               "for x in string_split(hit, '.')])"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) between 13 and 19 and {_LUHN}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 9 and 15"),
        "iban": (r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", _worth(
            f"60 + case when {_MOD97} then 40 else -60 end", "iban|account|konto|compte|cuenta|bank",
            "order|serial|isbn", "[A-Za-z0-9]")),
        "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _worth(
            "30", "ssn|social|security|tax", "order|serial|isbn|part", "[0-9-]")),
        "tel": (r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}", _worth(
            "30", phone, "order|serial|isbn|part", "[0-9+().-]")),
        "secret": (r"""[=:]\x20?["'']?[A-Za-z0-9+/_-]{16,256}""", _SECRET_KEEP),
    }
    base = list(kinds)[:4]
    steps = ",".join(_spans_sql(k, p, keep, f"(stop - length({_VALUE}))" if k == "secret" else "start") for k, (p, keep) in kinds.items())
    joins = " ".join(f"left join {k}_spans {k} using (rid)" for k in kinds)

    def listed(names: list[str]) -> str:
        return "array_to_string(" + " || ".join(f"coalesce({k}.spans, [])" for k in names) + ", ',')"

    return f"""with recursive
numbered as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),{steps}
select doc_id, {', '.join(f'coalesce({k}.n, 0)::bigint as n_{k}' for k in base)},
    ({' + '.join(f'coalesce({k}.n, 0)' for k in list(kinds)[4:])})::bigint as n_added,
    sha256({listed(base)}) as base_sha256, {listed(list(kinds))} as spans
from numbered {joins}"""


PRIVATE_SQL = private_sql()
