"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op7_bpe_encoding_and_decoding
from .brown import op6_lm_scoring
from .decontaminate import op10_benchmark_decontamination
from .line_dedup import op4_line_dedup
from .near_dedup import op1_minhash_near_dedup
from .nearest import op5_approximate_nearest_neighbours
from .secrets import op9_secret_scans
from .substring_dedup import op3_substring_dedup
from .token_files import op2_token_id_binary_output
from .toxicity import op8_toxicity

_ALL = (
    op1_minhash_near_dedup, op2_token_id_binary_output, op3_substring_dedup, op4_line_dedup, op5_approximate_nearest_neighbours,
    op6_lm_scoring, op7_bpe_encoding_and_decoding, op8_toxicity, op9_secret_scans, op10_benchmark_decontamination,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DEDUP_SQL = f"""
with recursive w as (select doc_id, {_WORDS.format(text=_LOWER)} as ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
links as (
  select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r as (select doc_id, doc_id as other from s union select r.doc_id, links.y from r join links on r.other = links.x),
c as (select doc_id, min(other) as component_id from r group by 1)
select s.doc_id, cast(len(sh) as bigint) as n_shingles, component_id, s.doc_id = component_id as kept from s join c on s.doc_id = c.doc_id
"""

SUBSTRING_SQL = f"""
with w as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) - 18)) as pos from w where len(ws) >= 20),
k as (select doc_id, pos, row_number() over (partition by array_to_string(ws[pos:pos + 19], ' ') order by doc_id, pos) as turn from p),
gone as (select distinct doc_id, unnest(range(pos, pos + 20)) as j from k where turn > 1),
g as (select doc_id, list(j) as js from gone group by 1),
t as (
  select w.doc_id, len(ws) as n_words, coalesce(len(js), 0) as n_removed,
    case when js is null then ws else list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: not list_contains(js, x[2])), lambda x: x[1]) end as kept
  from w left join g on w.doc_id = g.doc_id)
select doc_id, cast(n_words as bigint) as n_words, cast(n_removed as bigint) as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from t
"""


def oracle_sql() -> dict[str, str]:
    """The other operators fit models, hash or code in ways that SQL can't say; they are tested against brute force or the library."""
    return {"op1_minhash_near_dedup": NEAR_DEDUP_SQL, "op3_substring_dedup": SUBSTRING_SQL}
