"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from eventlane.llm import mixing
from eventlane.llm.rules import RULES, mask, POLICIES

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_LEDGER = rf"""
d as (select row_number() over () rn, doc_id, coalesce(text, '') text, {_WORDS} w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from documents),
g as (select rn, i, array_to_string(w[i:i+4], ' ') s from (select rn, w, unnest(range(1, len(w) - 3)) i from d)),
r as (select rn, i, lead(i) over (partition by rn order by i) nx
      from (select rn, i, count(*) over (partition by rn, s) c from g) where c > 1),
rep as (select rn, sum(least(5, coalesce(nx - i, 5)))::bigint n_repeat_words from r group by rn),
m as (select doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, len(l)::bigint n_lines,
             (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words,
             (length(text) - length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ]', '', 'g')))::bigint n_upper
      from d left join rep using (rn)),
b as (select *, ({" + ".join(f"case when {rule} then {1 << k} else 0 end" for k, rule in enumerate(RULES.values()))})::bigint fail_bits from m)"""

OP8 = f"""with {_LEDGER}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {mask(POLICIES["base"])}) <> 0 base_failed, (fail_bits & {mask(POLICIES["base"]) | mask(POLICIES["v1"])}) = 0 kept, 'v1' "policy", fail_bits from b"""

ABLATION = f"""with {_LEDGER}, rule as (select * from (values {", ".join(f"('{r}', {1 << list(RULES).index(r)}::bigint)" for r in POLICIES["v1"])}) t(rule, bit))
select rule, count(*) filter (fail_bits & bit <> 0)::bigint n_failed, count(*) filter (fail_bits & {mask(POLICIES["v1"])} = bit)::bigint n_only from b, rule group by rule"""


def _seeded(seed: str, *cols: str) -> str:
    return "('0x' || substr(md5(concat_ws(':', '" + seed + "', " + ", ".join(f"coalesce(({c})::varchar, 'null')" for c in cols) + ")), 1, 15))::bigint"


def _quota(name: str, src: str, votes: str, party: str, group: str | None) -> str:
    """``src`` with ``quota`` by Sainte-Laguë."""
    part = f"partition by {group}" if group else ""
    g = f"{group}, " if group else ""
    both = [c for c in (group, party) if c]
    return f"""
{name}_1 as (select *, floor({votes} * greatest(0.0::double, seats - 0.5 * n) / v + 0.5)::bigint lo0, floor({votes} * (seats + 0.5 * n) / v + 0.5)::bigint + 1 hi
  from (select *, (sum({votes}) over ({part}))::double v, count(*) filter ({votes} > 0) over ({part}) n from {src})),
{name}_2 as (select *, case when v > 0 then greatest(0, lo0 - 1) else 0 end lo from {name}_1),
{name}_3 as (select *, seats - sum(lo) over ({part}) open from {name}_2),
{name}_4 as (select {g}{party}, open, {votes} / (2.0::double * k + 1.0::double) q from (select *, unnest(range(lo, hi + 1)) k from {name}_3 where {votes} > 0)),
{name}_5 as (select {", ".join(both)}, count(*) filter (rk <= open) won from (select *, row_number() over ({part} order by q desc, {party} nulls last) rk from {name}_4) group by {", ".join(both)}),
{name} as (select a.*, (a.lo + coalesce(c.won, 0))::bigint quota from {name}_3 a left join {name}_5 c on {" and ".join(f"a.{x} is not distinct from c.{x}" for x in both)})"""


OP7 = rf"""with
d as (select doc_id, source, len({_WORDS})::bigint size from documents),
s1 as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) rk from d group by source),
s2 as (select *, [{", ".join(map(str, mixing.WEIGHTS))}][((rk - 1) % {len(mixing.WEIGHTS)}) + 1]::bigint w, source_size * {mixing.MOST} ceiling, (sum(source_size) over ())::bigint total from s1),
s3 as (select *, (total - coalesce(sum(ceiling) over (order by ceiling::double / w, rk rows between unbounded preceding and 1 preceding), 0))::double
              / (sum(w) over (order by ceiling::double / w, rk rows between current row and unbounded following))::double lv from s2),
s4 as (select *, (select lv from s3 where lv * w <= ceiling order by ceiling::double / w, rk limit 1) f from s3),
s5 as (select source, source_size, coalesce(least(f * w, ceiling::double), ceiling::double) target, round(total::double / {mixing.BLOCK})::bigint seats,
              greatest(1, least(ceil(sqrt(source_size::double)), ceil(source_size::double / {mixing.SHARD_WORDS})))::bigint n_shards from s4),
{_quota("sq", "s5", "target", "source", None)},
e1 as (select d.*, sq.source_size, sq.target, sq.quota source_quota, sq.n_shards, {_seeded(mixing.SEED, "doc_id")} place from d join sq on d.source is not distinct from sq.source),
e2 as (select *, place % n_shards shard from e1),
e3 as (select *, (sum(size) over (partition by source, shard order by place, doc_id, size rows between unbounded preceding and current row))::bigint last from e2),
p0 as (select source, shard, sum(size)::bigint words, any_value(source_quota) seats from e2 group by source, shard),
{_quota("pq", "p0", "words", "shard", "source")},
p1 as (select source, shard, greatest(1, ceil(words::double / {mixing.BLOCK}))::bigint blocks, quota q0 from pq),
p2 as (select *, least(q0, blocks * {mixing.MOST}) q from p1),
p3 as (select source, shard, blocks, q // blocks copies, q % blocks picked,
              coalesce(list_filter([({_seeded(mixing.SEED + "-mul", "source", "shard")} + i) % greatest(blocks, 2) for i in range(64)], lambda x: gcd(x, blocks) = 1)[1], 1) mul,
              {_seeded(mixing.SEED + "-add", "source", "shard")} % blocks ad from p2),
x as (select e3.*, blocks, copies, picked, mul, ad from e3 join p3 on e3.source is not distinct from p3.source and e3.shard = p3.shard)
select doc_id, size, source_size, target,
       (copies * size + coalesce(list_sum([least(last, (j + 1) * {mixing.BLOCK}) - greatest(last - size, j * {mixing.BLOCK})
          for j in range((last - size) // {mixing.BLOCK}, (last - 1) // {mixing.BLOCK} + 1) if size > 0 and ((j % blocks) * mul + ad) % blocks < picked]), 0))::bigint taken
from x"""

OP10 = """with
d as (select row_number() over () rn, doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select rn, doc_id, i, substr(h, 2 * i + 1, 100) s from (select *, unnest(range(0, length(h) // 2 - 49)) i from d where doc_id is not null)),
hit as (select rn, i from (select *, min(doc_id) over (partition by s) low from w) where low < doc_id),
edge as (select rn, i, max(i + 50) over (partition by rn order by i rows between unbounded preceding and 1 preceding) reach from hit),
runs as (select rn, i, sum(case when reach is null or i > reach then 1 else 0 end) over (partition by rn order by i) k from edge),
spans as (select rn, min(i) a, max(i) + 50 b from runs group by rn, k),
byrow as (select rn, list(a order by a) a, list(b order by a) b, sum(b - a) n, count(*) c from spans group by rn)
select doc_id, (length(h) // 2)::bigint n_bytes, coalesce(n, 0)::bigint n_removed, coalesce(c, 0)::bigint n_spans,
       sha256(case when a is null then unhex(h) else unhex(array_to_string([substr(h, 2 * (case when k = 1 then 0 else b[k - 1] end) + 1,
         2 * ((case when k > len(a) then length(h) // 2 else a[k] end) - (case when k = 1 then 0 else b[k - 1] end))) for k in range(1, len(a) + 2)], '')) end) kept_sha256
from d left join byrow using (rn)"""

ORACLES: dict[str, str] = {"op7_mix_sainte_lague": OP7, "op8_rule_ledger": OP8, "rule_ablation": ABLATION, "op10_suffix_radix": OP10}
