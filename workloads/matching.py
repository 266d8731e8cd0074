"""Queries on duplicates: keys, blocks, fuzzy pairs, clusters, merging.

Pairs and clusters are checked at the usual threshold of 85. The checks of what is made of them
use threshold 100, where a cluster is all names equal without their legal form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerprep.operators import entity, merge
from workloads import oracle_rules as rules
from workloads.derived import derive, duckdb

SOURCE = duckdb("supplier_names")
KEYED = f"""s AS (SELECT *, {rules.tax_key('TAX_ID')} AS tk, {rules.suffixless('NAME')} AS bare FROM ({SOURCE})),
    keyed AS (SELECT *, CASE WHEN tk IS NULL THEN row_id ELSE min(row_id) OVER (PARTITION BY tk) END AS key_rep FROM s),
    named AS (SELECT *, trim(NAME) AS name_key, substring(bare, 1, 3) AS block FROM keyed),
    firsts AS (SELECT block, name_key, bare, min(row_id) AS rep, count(*) AS rows FROM named WHERE row_id = key_rep GROUP BY ALL)"""
MEMBERS = f"""{KEYED}, lead AS (SELECT block, bare, min(rep) AS leader FROM firsts GROUP BY ALL),
    base AS (SELECT n.row_id, n.NAME, l.leader AS group_id, f.rep FROM named n JOIN firsts f USING (block, name_key, bare)
      JOIN lead l USING (block, bare) WHERE n.row_id = n.key_rep),
    allm AS (SELECT group_id, row_id, rep, 0 AS tax, 0 AS anchor FROM base UNION ALL
      SELECT b.group_id, n.row_id, b.rep, 1, n.key_rep FROM named n JOIN base b ON n.key_rep = b.row_id WHERE n.row_id <> n.key_rep),
    members AS (SELECT *, CASE WHEN tax = 1 THEN 'tax_id' WHEN rep = group_id THEN 'primary' ELSE 'fuzzy' END AS match_type,
      CASE WHEN rep = group_id THEN tax ELSE 2 END AS section, CASE WHEN rep = group_id THEN 0 ELSE rep END AS via
      FROM allm WHERE group_id IN (SELECT group_id FROM allm GROUP BY 1 HAVING count(*) > 1))"""


def _keyed(spark, folder) -> DataFrame:
    rows = entity.matching_rows(derive(spark, folder, "supplier_names"), "row_id", "NAME", tax_id="TAX_ID")
    return entity.exact_key_groups(rows)


def _members(spark, folder, threshold: float = 100.0, blocking: str = "first_3_chars") -> DataFrame:
    return entity.find_duplicates(
        derive(spark, folder, "supplier_names"), "row_id", "NAME", tax_id="TAX_ID", threshold=threshold, blocking=blocking
    )


def exact_key_groups(spark, folder):
    return _keyed(spark, folder).where("row_id <> key_rep").select("row_id", "key_rep")


def collapsed_names(spark, folder):
    return entity.collapse_names(_keyed(spark, folder)).select("block", "name_key", "rep", "rows")


def block_sizes(spark, folder):
    return entity.block_sizes(_keyed(spark, folder))


def _pairs(spark, folder, scorer: str):
    names = entity.collapse_names(_keyed(spark, folder))
    pairs = entity.fuzzy_pairs(names, 85.0, scorer)
    return pairs.select("a", "b", F.round("score", 4).alias("score"))


def fuzzy_pairs_lev(spark, folder):
    return _pairs(spark, folder, "levenshtein")


PAIRS_SQL = f"""WITH {KEYED}, v AS (SELECT block, bare, min(rep) AS vid FROM firsts WHERE bare <> '' GROUP BY ALL)
    SELECT x.vid AS a, y.vid AS b, round((length(x.bare) + length(y.bare) - levenshtein(x.bare, y.bare)) / (length(x.bare) + length(y.bare)) * 100, 4) AS score
    FROM v x JOIN v y ON x.block = y.block AND x.vid < y.vid
    WHERE (length(x.bare) + length(y.bare) - levenshtein(x.bare, y.bare)) * 200 >= 85 * 2 * (length(x.bare) + length(y.bare))"""


# Longest common subsequence of x.bare and y.bare, bit by bit: a bit of v is 0 where a letter of
# y.bare is matched, and each letter of x.bare moves matches as far to the front as they go.
_BITS = """list_transform(range(1, length(x.bare) + 1), lambda i: list_sum(list_transform(range(1, length(y.bare) + 1),
      lambda j: CASE WHEN y.bare[j] = x.bare[i] THEN 1::HUGEINT << (j - 1)::INTEGER ELSE 0::HUGEINT END))::HUGEINT)"""
_FULL = "((1::HUGEINT << length(y.bare)::INTEGER) - 1)"
_LCS = f"""length(y.bare) - bit_count(list_reduce(list_prepend({_FULL}, {_BITS}),
      lambda v, m: ((v + (v & m)) | (v - (v & m))) & {_FULL}))"""
# No pair has fewer single-letter insertions and deletions than its edit distance.
INDEL_SQL = f"""WITH {KEYED}, v AS (SELECT block, bare, min(rep) AS vid FROM firsts WHERE bare <> '' GROUP BY ALL),
    near AS MATERIALIZED (SELECT x.vid AS a, y.vid AS b, x.bare AS one, y.bare AS two FROM v x JOIN v y ON x.block = y.block AND x.vid < y.vid
      WHERE levenshtein(x.bare, y.bare) * 100 <= 15 * (length(x.bare) + length(y.bare))),
    scored AS (SELECT a, b, length(one) + length(two) AS total, {_LCS.replace("x.bare", "one").replace("y.bare", "two")} AS lcs FROM near)
    SELECT a, b, round(lcs * 200 / total, 4) AS score FROM scored WHERE lcs * 200 >= 85 * total"""


def fuzzy_pairs_indel(spark, folder):
    return _pairs(spark, folder, "indel")


def blocking_keys(spark, folder):
    """The block of every partner by each way of blocking."""
    rows = None
    for blocking in ("first_char", "postal_code_2", "province", "none"):
        one = entity.matching_rows(derive(spark, folder, "partner"), "row_id", "NAME", "TAX_ID", "POSTAL_CODE", "PROVINCE", blocking)
        one = one.select("row_id", F.lit(blocking).alias("blocking"), "block")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _blocking_sql() -> str:
    blank = ("CASE WHEN {c} IS NULL OR trim({c}) IN " + rules.in_list(('', '-', 'nan', 'NaN', 'None')) + " THEN NULL ELSE {v} END")
    bare = rules.suffixless("NAME")
    by_name = "CASE WHEN bare = '' THEN '_empty_' ELSE substring(bare, 1, {n}) END"
    digits = "regexp_replace(POSTAL_CODE, '[^0-9]', '', 'g')"
    postal = blank.format(c="POSTAL_CODE", v=f"nullif(substring(CASE WHEN length({digits}) < 5 AND {digits} <> '' THEN lpad({digits}, 5, '0') ELSE {digits} END, 1, 2), '')")
    province = "nullif(nullif(upper(trim(coalesce(PROVINCE, 'nan'))), ''), '-')"
    ways = {
        "first_char": by_name.format(n=1), "postal_code_2": f"coalesce({postal}, {by_name.format(n=3)})",
        "province": f"coalesce({province}, {by_name.format(n=3)})", "none": "'_all_'",
    }
    named = blank.format(c="NAME", v="{v}")
    return f"WITH s AS (SELECT *, {bare} AS bare FROM ({duckdb('partner')})) " + " UNION ALL ".join(
        f"SELECT row_id, '{way}' AS blocking, {named.format(v=key)} AS block FROM s" for way, key in ways.items()
    )


def duplicate_members(spark, folder):
    return _members(spark, folder).select("group_id", "row_id", "match_type", "score")


def duplicate_summary(spark, folder):
    return entity.duplicate_summary(_members(spark, folder))


def leader_clusters(spark, folder):
    """Clusters at the usual threshold."""
    return _members(spark, folder, 85.0).select("group_id", "row_id", "match_type", F.round("score", 2).alias("score"))


def leader_clusters_unblocked(spark, folder):
    """The same with every name compared with every other."""
    return _members(spark, folder, 85.0, "none").select("group_id", "row_id", "match_type", F.round("score", 2).alias("score"))


def _led(block: str = "block") -> str:
    """Clusters at 85: names of a block in order of their first row; each follows the first leader it is near to."""
    head = MEMBERS.split(", lead AS")[0].replace("substring(bare, 1, 3) AS block", f"{block} AS block") if block != "block" else KEYED
    tail = MEMBERS[MEMBERS.index("base AS"):]
    near = INDEL_SQL[INDEL_SQL.index("v AS"):INDEL_SQL.index("    SELECT a, b, round")]
    return f"""WITH RECURSIVE {head}, {near},
    pairs AS MATERIALIZED (SELECT a, b, lcs * 200 / total AS score FROM scored WHERE lcs * 200 >= 85 * total),
    spots AS MATERIALIZED (SELECT block, bare, vid, row_number() OVER (PARTITION BY block ORDER BY vid) AS spot,
      coalesce((SELECT list(a ORDER BY a) FROM pairs WHERE b = vid), []) AS earlier FROM v),
    walk AS (SELECT block, 0::BIGINT AS spot, []::BIGINT[] AS leaders, NULL::BIGINT AS vid, NULL::BIGINT AS leader FROM (SELECT DISTINCT block FROM v)
      UNION ALL SELECT w.block, s.spot, CASE WHEN list_has_any(s.earlier, w.leaders) THEN w.leaders ELSE list_append(w.leaders, s.vid) END, s.vid,
        coalesce(list_min(list_filter(s.earlier, lambda e: list_contains(w.leaders, e))), s.vid)
      FROM walk w JOIN spots s ON s.block = w.block AND s.spot = w.spot + 1),
    lead AS (SELECT v.block, v.bare, w.leader FROM v JOIN walk w USING (vid)
      UNION ALL SELECT block, bare, rep FROM firsts WHERE bare = ''), {tail}
    SELECT m.group_id, m.row_id, m.match_type, CASE WHEN m.match_type <> 'fuzzy' THEN 100.0::DOUBLE
      ELSE round(coalesce(p.score, 100.0), 2) END AS score
    FROM members m LEFT JOIN firsts f ON f.rep = m.rep LEFT JOIN v USING (block, bare) LEFT JOIN pairs p ON p.a = m.group_id AND p.b = v.vid"""


_COLUMNS = ["row_id", "NAME", "TAX_ID", "EMAIL", "EMAIL_VALID"]


def _merged(policy: str):
    def run(spark, folder):
        df = derive(spark, folder, "supplier_names")
        return merge.apply_policies(df, _members(spark, folder), "row_id", policy).select(*_COLUMNS)

    return run


def _kept_sql(kept: str) -> str:
    return f"""WITH {MEMBERS} SELECT {', '.join(_COLUMNS)} FROM s
      WHERE row_id NOT IN (SELECT row_id FROM members) OR row_id IN (SELECT {kept} FROM members GROUP BY group_id)"""


def _filled(c: str) -> str:
    return f"{c} IS NOT NULL AND trim({c}) NOT IN {rules.in_list(('', '-', 'nan', 'NaN', 'None'))}"


_ORDER = "section, via, tax, anchor, row_id"
MERGE_SQL = f"""WITH {MEMBERS}, full_rows AS (SELECT m.*, s.NAME, s.TAX_ID, s.EMAIL, s.EMAIL_VALID FROM members m JOIN s USING (row_id)),
    g AS (SELECT group_id AS row_id, first(NAME ORDER BY {_ORDER}) FILTER (WHERE {_filled('NAME')}) AS NAME,
      first(TAX_ID ORDER BY {_ORDER}) FILTER (WHERE {_filled('TAX_ID')}) AS TAX_ID, first(TAX_ID ORDER BY {_ORDER}) AS own_tax,
      first(EMAIL ORDER BY NOT EMAIL_VALID, {_ORDER}) FILTER (WHERE {_filled('EMAIL')}) AS EMAIL, first(EMAIL ORDER BY {_ORDER}) AS own_email,
      first(EMAIL_VALID ORDER BY NOT EMAIL_VALID, {_ORDER}) FILTER (WHERE {_filled('EMAIL')}) AS EMAIL_VALID,
      first(EMAIL_VALID ORDER BY {_ORDER}) AS own_valid FROM full_rows GROUP BY group_id)
    SELECT row_id, NAME, TAX_ID, EMAIL, EMAIL_VALID FROM s WHERE row_id NOT IN (SELECT row_id FROM members)
    UNION ALL SELECT row_id, NAME, coalesce(TAX_ID, own_tax), coalesce(EMAIL, own_email), coalesce(EMAIL_VALID, own_valid) FROM g"""


def merge_by_table(spark, folder):
    """A policy per group, from a table: the group's number decides."""
    df = derive(spark, folder, "supplier_names")
    members = _members(spark, folder)
    names = F.array(*[F.lit(p) for p in ("no_merge", "keep_primary", "keep_first", "keep_last")])
    policies = members.where("row_id = group_id").select(
        "group_id", names[(F.col("group_id") % 4).cast("int")].alias("policy")
    )
    return merge.apply_policies(df, members, "row_id", "merge", policies).select(*_COLUMNS)


BY_TABLE_SQL = f"""WITH {MEMBERS} SELECT {', '.join(_COLUMNS)} FROM s WHERE row_id NOT IN (SELECT row_id FROM members)
    OR row_id IN (SELECT row_id FROM members WHERE group_id % 4 = 0)
    OR row_id IN (SELECT CASE WHEN group_id % 4 = 1 THEN group_id WHEN group_id % 4 = 2 THEN min(row_id) ELSE max(row_id) END
      FROM members WHERE group_id % 4 > 0 GROUP BY group_id)"""


def rows_merged_away(spark, folder):
    return merge.merged_away(_members(spark, folder))


PAIRS = {
    "exact_key_groups": (exact_key_groups, f"WITH {KEYED} SELECT row_id, key_rep FROM keyed WHERE row_id <> key_rep"),
    "collapsed_names": (collapsed_names, f"WITH {KEYED} SELECT block, name_key, rep, rows FROM firsts"),
    "block_sizes": (block_sizes, f"WITH {KEYED} SELECT block, CAST(sum(rows) AS bigint) AS rows, count(*) AS names FROM firsts GROUP BY 1"),
    "fuzzy_pairs_lev": (fuzzy_pairs_lev, PAIRS_SQL),
    "fuzzy_pairs_indel": (fuzzy_pairs_indel, INDEL_SQL),
    "blocking_keys": (blocking_keys, _blocking_sql()),
    "duplicate_members": (duplicate_members, f"WITH {MEMBERS} SELECT group_id, row_id, match_type, 100.0::double AS score FROM members"),
    "duplicate_summary": (
        duplicate_summary,
        f"""WITH {MEMBERS} SELECT count(DISTINCT group_id) AS duplicate_groups, CAST(count(DISTINCT group_id) + count(*) FILTER (WHERE tax = 1)
          + count(DISTINCT rep) FILTER (WHERE match_type = 'fuzzy') AS bigint) AS records_affected FROM members""",
    ),
    "leader_clusters": (leader_clusters, _led()),
    "leader_clusters_unblocked": (leader_clusters_unblocked, _led("''")),
    "merge_fields": (_merged("merge"), MERGE_SQL),
    "merge_keep_primary": (_merged("keep_primary"), _kept_sql("group_id")),
    "merge_keep_first": (_merged("keep_first"), _kept_sql("min(row_id)")),
    "merge_keep_last": (_merged("keep_last"), _kept_sql("max(row_id)")),
    "merge_none": (_merged("no_merge"), f"SELECT {', '.join(_COLUMNS)} FROM ({SOURCE})"),
    "merge_by_table": (merge_by_table, BY_TABLE_SQL),
    "rows_merged_away": (
        rows_merged_away, f"WITH {MEMBERS} SELECT count(*) - count(DISTINCT group_id) AS duplicates_merged FROM members"
    ),
}
QUERIES = {name: pair[0] for name, pair in PAIRS.items()}
ORACLES = {name: pair[1] for name, pair in PAIRS.items() if pair[1] is not None}
