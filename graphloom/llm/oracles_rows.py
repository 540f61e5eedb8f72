"""SQL (DuckDB) for mixing, the manifest and vector codes, by levels and rounds written out one after another."""

from __future__ import annotations

from . import op11_mixing as op11
from . import op12_merkle_manifest as op12
from . import op13_vector_codes as op13

#: Levels written out: enough for FAN ** LEVELS documents of a source.
LEVELS = 3


def _draw(*parts: str) -> str:
    key = ", ".join(f"coalesce(({p})::VARCHAR, '-')" for p in parts)
    return f"(('0x' || substr(md5(concat_ws('|', '{op11.SEED}', {key})), 1, 12))::BIGINT / 281474976710656.0)"


def _level(k: int) -> str:
    """Items of a level in order, and the walk over them: a row for each item, settled or left."""
    source = (
        "units_0"
        if k == 0
        else f"(SELECT source, bucket // {op11.FAN} AS bucket, doc_id, size, n_rows, base, after AS mass FROM walk_{k - 1} WHERE k > 0 AND NOT whole)"
    )
    draw = _draw(f"'pair{k}'", "source", "doc_id", "size")
    return f"""
items_{k} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY size DESC, draw, doc_id NULLS FIRST) AS k FROM (SELECT *, {draw} AS draw FROM {source})
),
walk_{k} AS (
  SELECT source, bucket, 0::BIGINT AS k, NULL::BIGINT AS doc_id, NULL::BIGINT AS size, NULL::BIGINT AS n_rows, NULL::BIGINT AS base, true AS whole, false AS up, 0.0::DOUBLE AS after,
         1.0::DOUBLE AS a, 0.0::DOUBLE AS b, list_reduce(list(mass ORDER BY k), lambda x, y: x + y, 0.0::DOUBLE) AS pool, sum(size)::DOUBLE AS sizes
  FROM items_{k} GROUP BY source, bucket
  UNION ALL
  SELECT source, bucket, k, doc_id, size, n_rows, base, whole, is_full AND NOT is_empty AND size > 0, CASE WHEN goes_up THEN m + gains WHEN goes_down THEN m - loses ELSE m END,
         CASE WHEN emptied OR filled THEN 0.0 WHEN goes_up THEN a * (1 - gains / pool) WHEN goes_down THEN a * (1 - loses / room) ELSE a * 1.0 END,
         CASE WHEN emptied THEN 0.0 WHEN filled THEN 1.0 WHEN goes_up THEN b * (1 - gains / pool) + 0.0 WHEN goes_down THEN b * (1 - loses / room) + loses / room ELSE b * 1.0 + 0.0 END,
         CASE WHEN emptied THEN 0.0 WHEN filled THEN pool + room WHEN goes_up THEN pool - gains WHEN goes_down THEN pool + loses ELSE pool END, sizes
  FROM (
    SELECT *, ((is_full AND size > 0) OR is_empty OR size = 0) AS whole, (goes_up AND gains >= pool) AS emptied, (goes_down AND loses >= room) AS filled
    FROM (
      SELECT *, (m >= size OR (goes_up AND gains >= size - m)) AS is_full, (m <= 0 OR (goes_down AND loses >= m)) AS is_empty
      FROM (
        SELECT *, (broken AND NOT goes_up AND loses > 0) AS goes_down
        FROM (
          SELECT *, (broken AND gains > 0 AND draw * (gains + loses) < loses) AS goes_up
          FROM (
            SELECT *, least(size::DOUBLE - m, pool) AS gains, least(m, room) AS loses, (m > 0 AND m < size) AS broken
            FROM (
              SELECT *, greatest(sizes - pool, 0.0::DOUBLE) AS room
              FROM (
                SELECT * REPLACE (greatest(pool - m, 0.0::DOUBLE) AS pool)
                FROM (
                  SELECT i.*, w.a, w.b, w.pool, w.sizes - i.size::DOUBLE AS sizes, greatest(0.0::DOUBLE, least(i.size::DOUBLE, w.a * i.mass + w.b * i.size::DOUBLE)) AS m
                  FROM walk_{k} w JOIN items_{k} i ON i.source IS NOT DISTINCT FROM w.source AND i.bucket = w.bucket AND i.k = w.k + 1
                )
              )
            )
          )
        )
      )
    )
  )
)"""


_LAST = LEVELS - 1
OP11 = f"""WITH RECURSIVE
counted AS MATERIALIZED (
  SELECT source, doc_id, size, count(*) AS n_rows
  FROM (SELECT source, doc_id, coalesce(len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')), 0)::BIGINT AS size FROM documents)
  GROUP BY source, doc_id, size
),
sizes AS (
  SELECT source, sum(size * n_rows)::BIGINT AS source_size, count(*) AS n_units, [{", ".join(map(str, op11.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(op11.WEIGHTS)} + 1] AS weight
  FROM counted GROUP BY source
),
ranked AS (
  SELECT *, (sum(source_size) OVER () * {op11.SHARE_PERCENT / 100} - coalesce(sum({op11.MOST_COPIES} * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS ratio
  FROM sizes WINDOW b AS (ORDER BY {op11.MOST_COPIES} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
aims AS MATERIALIZED (
  SELECT source, source_size, n_units,
         CASE WHEN ratio * weight > {op11.MOST_COPIES} * source_size THEN ({op11.MOST_COPIES} * source_size)::DOUBLE
              ELSE max(CASE WHEN ratio * weight > {op11.MOST_COPIES} * source_size THEN NULL ELSE ratio END) OVER () * weight END AS target
  FROM ranked
),
units AS (
  SELECT c.*, a.n_units, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio
  FROM counted c JOIN aims a ON c.source IS NOT DISTINCT FROM a.source
),
extras AS (SELECT *, floor(ratio) AS whole, n_rows * (ratio - floor(ratio)) AS extra FROM units),
units_0 AS (
  SELECT source, floor({_draw("'place'", "source", "doc_id", "size")} * ceil(n_units / {op11.FAN}))::BIGINT AS bucket, doc_id, size, n_rows,
         (n_rows * whole + floor(extra))::BIGINT AS base, (extra - floor(extra)) * size AS mass
  FROM extras
),
{",".join(_level(k) for k in range(LEVELS))},
done AS (
  {" UNION ALL ".join(f"SELECT source, doc_id, size, n_rows, base + up::BIGINT AS copies FROM walk_{k} WHERE k > 0 AND whole" for k in range(LEVELS))}
  UNION ALL
  SELECT source, doc_id, size, n_rows, base + ({_draw("'last'", "source", "doc_id", "size")} * size < after)::BIGINT FROM walk_{_LAST} WHERE k > 0 AND NOT whole
),
spread AS (SELECT source, doc_id, size, copies // n_rows + (unnest(range(n_rows)) < copies % n_rows)::BIGINT AS copies FROM done)
SELECT s.doc_id, s.source, s.size, a.source_size, a.target, s.copies, s.copies * s.size AS taken
FROM spread s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
"""

#: Levels written out: enough for FAN ** HEIGHT leaves of a source, and as many sources.
HEIGHT = 5


def _tree(name: str, leaves: str) -> str:
    """nodes of ``leaves`` (grp, pos, digest) at each level, as runs of FAN; a level is there while more than one node is left below."""
    parts = [f"{name}_0 AS MATERIALIZED (SELECT grp, pos, digest, count(*) OVER (PARTITION BY grp) AS n FROM {leaves})"]
    for k in range(HEIGHT):
        parts.append(f"{name}_runs_{k} AS MATERIALIZED (SELECT grp, pos // {op12.FAN} AS pos, string_agg(digest, '' ORDER BY pos) AS run FROM {name}_{k} WHERE n > 1 GROUP BY grp, pos // {op12.FAN})")
        parts.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT grp, pos, sha256(run) AS digest, count(*) OVER (PARTITION BY grp) AS n FROM {name}_runs_{k})")
    return ",\n".join(parts)


def _climb(name: str, tree: str, start: str) -> str:
    """From ``start`` (grp, pos, proof, node, ...) up a tree: siblings are added to the proof and the node is folded."""
    parts = [f"{name}_0 AS (SELECT * FROM {start})"]
    for k in range(HEIGHT):
        before, after = f"left(run, 64 * (c.pos % {op12.FAN}))", f"substr(run, 64 * (c.pos % {op12.FAN}) + 65)"
        parts.append(
            f"{name}_{k + 1} AS (SELECT c.* REPLACE (c.pos // {op12.FAN} AS pos, proof || coalesce({before} || {after}, '') AS proof, CASE WHEN run IS NULL THEN node ELSE sha256({before} || node || {after}) END AS node) "
            f"FROM {name}_{k} c LEFT JOIN {tree}_runs_{k} r ON r.grp = c.grp AND r.pos = c.pos // {op12.FAN})"
        )
    return ",\n".join(parts)


def _leaf(text: str) -> str:
    value = "coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    return "sha256(" + " || ".join(value.format(c=text if c == "text" else c) for c in op12.COLUMNS) + ")"


#: CRC-32 of the decimal doc_id, bit by bit.
_BITS = "list_transform(range(8 * length(doc_id::VARCHAR)), lambda k: CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INTEGER, 1))::BIGINT ELSE 0::BIGINT END)"
_CRC = f"xor(list_reduce({_BITS}, lambda c, b: xor(xor(c, b) >> 1, 3988292384::BIGINT * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)"

OP12 = f"""WITH
sources AS (SELECT source AS its, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS grp FROM (SELECT DISTINCT source FROM documents)),
leaves AS MATERIALIZED (
  SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, doc_id, digest, copy
  FROM (
    SELECT doc_id, source, {_leaf("text")} AS digest,
           CASE WHEN {_CRC} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS copy
    FROM documents
  ) d JOIN sources s ON d.source IS NOT DISTINCT FROM s.its
),
{_tree("tree", "leaves")},
subroots AS MATERIALIZED ({" UNION ALL ".join(f"SELECT grp, digest FROM tree_{k} WHERE n = 1" for k in range(HEIGHT + 1))}),
tops AS (SELECT 0 AS grp, grp AS pos, digest FROM subroots),
{_tree("top", "tops")},
roots AS ({" UNION ALL ".join(f"SELECT digest AS root FROM top_{k} WHERE n = 1" for k in range(HEIGHT + 1))}),
own AS (SELECT grp, pos, doc_id, digest AS leaf, '' AS proof, copy AS node FROM leaves),
{_climb("low", "tree", "own")},
mid AS (SELECT 0 AS grp, low.grp AS pos, doc_id, leaf, proof, node, digest AS subroot FROM low_{HEIGHT} low JOIN subroots s ON low.grp = s.grp),
{_climb("high", "top", "mid")}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM high_{HEIGHT}, roots
"""


def _assigned(name: str, book: str) -> str:
    """The nearest entry of each part and its squared distance."""
    square = "list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    return f"{name} AS MATERIALIZED (SELECT n, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT v.n, v.part, b.entry, {square} AS d FROM parts v JOIN {book} b USING (part)) GROUP BY n, part)"


def _moved(name: str, book: str, assigned: str) -> str:
    means = f"SELECT part, entry, k, (sum(x) - CASE WHEN sum(x) % count(*) < 0 THEN sum(x) % count(*) + count(*) ELSE sum(x) % count(*) END) // count(*) AS x FROM (SELECT part, entry, unnest(v.x) AS x, generate_subscripts(v.x, 1) AS k FROM parts v JOIN {assigned} USING (n, part)) GROUP BY part, entry, k"
    return f"{name} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (SELECT part, entry, list(x::BIGINT ORDER BY k) AS x FROM ({means}) GROUP BY part, entry) m USING (part, entry))"


_R = op13.ROUNDS
OP13 = f"""WITH
kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS n, vec_id, label, x
  FROM (SELECT vec_id, label, list_transform(embedding, lambda e: floor(e::DOUBLE * {op13.SCALE})::BIGINT) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)
),
parts AS MATERIALIZED (SELECT n, part, x[part * len(x) // {op13.PARTS} + 1 : (part + 1) * len(x) // {op13.PARTS}] AS x FROM (SELECT n, x, unnest(range({op13.PARTS})) AS part FROM kept)),
book_0 AS MATERIALIZED (SELECT part, n - 1 AS entry, x FROM parts WHERE n <= {op13.ENTRIES}),
{",".join(f"{_assigned(f'near_{r}', f'book_{r}')},{_moved(f'book_{r + 1}', f'book_{r}', f'near_{r}')}" for r in range(_R))},
{_assigned("last", f"book_{_R}")},
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book_{_R}),
coded AS (SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last GROUP BY n)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (n), books
"""
