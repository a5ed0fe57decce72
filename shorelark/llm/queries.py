"""The registered queries of this subpackage: thin digests of the operators' outputs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shorelark.llm.centroids import CENTROIDS, COMPONENTS, ROUNDS, STEPS_PER_UNIT, cluster
from shorelark.llm.common import read
from shorelark.llm.decontaminate import decontaminate
from shorelark.llm.exact_dedup import exact_dedup
from shorelark.llm.language_id import held_out, label, train
from shorelark.llm.licenses import scan
from shorelark.llm.line_dedup import line_dedup
from shorelark.llm.manifest import build, checked, leaf_digest
from shorelark.llm.packing import pack
from shorelark.llm.simhash import simhash_dedup
from shorelark.llm.suffix_dedup import suffix_dedup
from shorelark.llm.token_files import read_token_files, write_token_files
from shorelark.llm.warc_audit import audit, copy_archive, leaves, write_archive
from shorelark.llm.wrappers import extract
from shorelark.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op1_simhash_dedup")
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["length"])
    return suffix_dedup(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = label(docs, train(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_files(read(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)


@query("op7_exact_dedup", """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
  count(*) over (partition by coalesce(text, '')) as group_size,
  doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept, sha256(coalesce(text, '')) as text_sha256
from documents""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).drop("rid")


@query("op8_line_dedup", r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
held as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select k.doc_id, count(*) as n_lines, count(*) filter (where h.key is not null and k.doc_id <> h.keeper) as n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) order by k.pos) filter (where h.key is null or k.doc_id = h.keeper), '')) as kept_sha256
from keyed k left join held h on k.key = h.key group by k.doc_id""")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_warc_audit", """
select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_sha256,
  substr(sha256(cast(page_id as varchar)), 1, 2) <> '00' as intact
from pages""")
def op9_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of all pages is copied, a byte in one of 256 records being changed, and the copy is audited."""
    primary, copy = scratch_path(spark, "warc"), scratch_path(spark, "warc-copy")
    index = write_archive(read(spark, sf_dir, "pages"), primary)
    copy_archive(index, primary, copy, spoil=F.sha2(F.col("page_id").cast("string"), 256).startswith("00"))
    damaged = audit(index, leaves(index, copy)).withColumn("damaged", F.lit(True))
    found = index.join(damaged, ["file", "record"], "left")
    return found.select("page_id", "payload_bytes", "payload_sha256", F.col("damaged").isNull().alias("intact"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def _clusters_sql() -> str:
    """Rounds of one common table expression each; the first centroids are the vectors of the smallest hashes."""
    parts = [
        f"kept as materialized (select vec_id, [cast(floor({STEPS_PER_UNIT} * cast(x as double)) as bigint) for x in embedding] as v from embeddings "
        f"where len(embedding) = {COMPONENTS} and len([x for x in embedding if x is not null and isfinite(x)]) = {COMPONENTS})",
        "c0 as materialized (select cast(row_number() over (order by h) - 1 as int) as cluster, v from "
        f"(select sha256('2:' || cast(vec_id as varchar)) as h, v from kept order by h limit {CENTROIDS}) x)",
    ]
    gap = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for i in range(ROUNDS + 1):
        parts.append(
            f"a{i} as materialized (select vec_id, v, m.cluster as cluster, m.d as distance from (select k.vec_id, k.v, "
            f"min({{'d': cast({gap} as bigint), 'cluster': c.cluster}}) as m from kept k cross join c{i} c group by k.vec_id, k.v) x)"
        )
        if i < ROUNDS:
            parts.append(
                f"m{i} as (select cluster, list(cast(floor_mean as bigint) order by j) as v from (select cluster, j, "
                "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as floor_mean from "
                f"(select cluster, unnest(v) as x, generate_subscripts(v, 1) as j from a{i}) y group by cluster, j) z group by cluster)"
            )
            parts.append(f"c{i + 1} as materialized (select c.cluster, coalesce(m.v, c.v) as v from c{i} c left join m{i} m on c.cluster = m.cluster)")
    return f"""with {", ".join(parts)}
select a.vec_id, a.cluster, a.distance, cast(sum(a.distance) over (partition by a.cluster) as bigint) as cluster_inertia,
  cast(sum(a.distance) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{ROUNDS} a join c{ROUNDS} c on a.cluster = c.cluster"""


@query("op11_centroid_clusters", _clusters_sql())
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(read(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("components").cast("array<string>"), ","), 256)
    centroids = found.centroids.select("cluster", F.col("inertia").alias("cluster_inertia"), digest.alias("centroid_sha256"))
    return found.rows.join(centroids, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(found.inertia).cast("bigint").alias("inertia"), "centroid_sha256"
    )


def _leaf_sql(n_chars: str = "n_chars") -> str:
    def part(c: str) -> str:
        value = f"cast({c} as varchar)"
        return f"coalesce(cast(octet_length(encode({value})) as varchar) || ':' || {value}, '-')"

    return f"sha256({part('doc_id')} || {part('source')} || {part('lang')} || {part(n_chars)} || {part('text')})"


_CRC_STEP = "xor(x >> 1, (x & 1) * 3988292384)"  # fixed value: the reflected polynomial of CRC-32


@query("op12_merkle_manifest", f"""
with recursive crc(b, x, k) as (
  select cast(range as bigint), cast(range as bigint), 0 from range(256)
  union all select b, {_CRC_STEP}, k + 1 from crc where k < 8),
crcs as (select list(x order by b) as t from crc where k = 8),
named as (
  select *, coalesce(':' || lang, '-') as grp,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
      lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1]))) % 7 = 0 as touched
  from documents cross join crcs),
leaves as (
  select doc_id, grp, {_leaf_sql()} as leaf, case when touched then {_leaf_sql("(n_chars + 1)")} else {_leaf_sql()} end as other from named),
slots as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as slot, count(*) over (partition by grp) as n from leaves),
tree(grp, lev, i, h, n) as (
  select grp, 0, slot, leaf, n from slots
  union all
  select grp, lev + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from tree where n > 1 group by grp, lev, i // 2, n),
subs as (select grp, h as subroot, row_number() over (order by grp) - 1 as gslot, count(*) over () as gn from tree where n = 1),
crown(lev, i, h, n) as (
  select 0, gslot, subroot, gn from subs
  union all
  select lev + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from crown where n > 1 group by lev, i // 2, n),
steps as (
  select s.doc_id, s.grp, s.slot, t.lev as step, (s.slot >> t.lev) & 1 as odd, o.h as sib
  from slots s join (select distinct grp, lev from tree where n > 1) t on s.grp = t.grp
    left join tree o on o.grp = s.grp and o.lev = t.lev and o.i = xor(s.slot >> t.lev, 1)
  union all
  select s.doc_id, s.grp, s.slot, 1000 + t.lev, (b.gslot >> t.lev) & 1, o.h
  from slots s join subs b on s.grp = b.grp join (select distinct lev from crown where n > 1) t on true
    left join crown o on o.lev = t.lev and o.i = xor(b.gslot >> t.lev, 1)),
paths as (
  select grp, slot, list({{'odd': odd, 'sib': sib}} order by step) as path, coalesce(string_agg(sib, '' order by step), '') as sibs from steps group by grp, slot),
climb(grp, slot, k, h, path) as (
  select s.grp, s.slot, 1, s.other, p.path from slots s left join paths p on s.grp = p.grp and s.slot = p.slot
  union all
  select grp, slot, k + 1, sha256(case when path[k].sib is null then h when path[k].odd = 1 then path[k].sib || h else h || path[k].sib end), path
  from climb where k <= len(path)),
ends as (select grp, slot, arg_max(h, k) as folded_root from climb group by grp, slot)
select s.doc_id, s.leaf, b.subroot, r.h as root, sha256(coalesce(p.sibs, '')) as proof_sha256, e.folded_root, e.folded_root = r.h as verified
from slots s join subs b on s.grp = b.grp join crown r on r.n = 1 join ends e on e.grp = s.grp and e.slot = s.slot
  left join paths p on p.grp = s.grp and p.slot = s.slot""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the CRC-32 of the id, the row that is checked has one more in n_chars than the one in the manifest."""
    touched = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + touched.cast("int"), F.col("text"))
    found = build(read(spark, sf_dir, "documents"), carry={"other": F.when(touched, changed)})
    rows = checked(found.rows.withColumn("other", F.coalesce("other", "leaf")), "other")
    text = {c: F.lower(F.hex(c)).alias(n) for c, n in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"), ("siblings", "proof_sha256"), ("folded", "folded_root"))}
    return rows.select("doc_id", *text.values(), (F.col("folded") == F.col("root")).alias("verified"))


@query("op13_html_text")
def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
