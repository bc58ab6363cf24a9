"""DuckDB SQL for what SQL can state."""

from __future__ import annotations

from .licenses import LEAST_DICE, RIVAL_DICE, TEMPLATES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licenses() -> str:
    """Every unit against every template, without pruning; of rivals the likest."""
    values = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in sorted(TEMPLATES.items()))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def words(column: str) -> str:
        return f"regexp_extract_all(translate({column}, '{upper}', '{lower}'), '[a-z0-9]+')"

    pairs = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    return f"""
    WITH template AS (
      SELECT license, {pairs} AS grams
      FROM (SELECT license, {words("notice")} AS w FROM (VALUES {values}) AS t(license, notice))
    ), split AS (
      SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
    ), unit AS (
      SELECT doc_id, 0 AS k, text AS unit FROM split WHERE len(lines) > 1
      UNION ALL
      SELECT doc_id, unnest(range(1, len(lines) + 1)) AS k, unnest(lines) AS unit FROM split
    ), grams AS (
      SELECT doc_id, k, {pairs} AS grams FROM (SELECT doc_id, k, {words("unit")} AS w FROM unit)
    ), rival AS (
      SELECT a.license, b.license AS other FROM template a JOIN template b ON a.license <> b.license
        AND 2 * len(list_intersect(a.grams, b.grams)) >= {RIVAL_DICE} * (len(a.grams) + len(b.grams))
    ), reached AS (
      SELECT doc_id, k, license, 2 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
      FROM grams g, template t
      WHERE len(g.grams) > 0 AND len(g.grams) <= 3 * len(t.grams) AND len(t.grams) <= 3 * len(g.grams)
        AND 2 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) >= {LEAST_DICE}
    ), shown AS (
      SELECT * FROM reached s WHERE NOT EXISTS (
        SELECT 1 FROM reached o JOIN rival r ON r.other = o.license
        WHERE o.doc_id = s.doc_id AND o.k = s.k AND r.license = s.license
          AND (o.dice > s.dice OR (o.dice = s.dice AND o.license < s.license)))
    ), best AS (
      SELECT doc_id, count(DISTINCT k) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
        max(dice) AS best_dice
      FROM shown GROUP BY doc_id
    ), named AS (
      SELECT doc_id, min(license) AS best_license FROM shown JOIN best USING (doc_id) WHERE dice = best_dice GROUP BY doc_id
    )
    SELECT doc_id, len(lines) AS n_lines, coalesce(n_notices, 0) AS n_notices, coalesce(licenses, '') AS licenses,
      best_license, best_dice
    FROM split LEFT JOIN best USING (doc_id) LEFT JOIN named USING (doc_id)
    """


LICENSES_SQL = _licenses()


def _centroids(dims: int = 64, clusters: int = 8, rounds: int = 10) -> str:
    """Every round as a step of its own; distances from whole vectors, without blocks."""
    nearest = """
      SELECT row, vec_id, x, number, d FROM (
        SELECT v.row, v.vec_id, v.x, c.number,
               list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
        FROM kept v CROSS JOIN {centroids} c
      ) QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, number) = 1"""
    steps = []
    for k in range(rounds):
        steps.append(f"near{k} AS MATERIALIZED ({nearest.format(centroids=f'c{k}')})")
        steps.append(f"""c{k + 1} AS MATERIALIZED (
      SELECT o.number, coalesce(n.x, o.x) AS x FROM c{k} o LEFT JOIN (
        SELECT number, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS x
        FROM (SELECT number, i, sum(value) AS s, count(*) AS n
              FROM (SELECT number, unnest(range(1, {dims} + 1)) AS i, unnest(x) AS value FROM near{k}) GROUP BY number, i)
        GROUP BY number
      ) n ON n.number = o.number)""")
    body = ",\n    ".join(steps)
    return f"""
    WITH kept AS MATERIALIZED (
      SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x
      FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = {dims}
    ), c0 AS MATERIALIZED (
      SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR) NULLS LAST, x) - 1 AS INTEGER) AS number, x FROM kept
      QUALIFY number < {clusters}
    ), {body},
    last AS MATERIALIZED ({nearest.format(centroids=f'c{rounds}')})
    SELECT l.vec_id, l.number AS cluster, l.d AS distance,
           sum(l.d) OVER (PARTITION BY l.number)::BIGINT AS cluster_inertia, sum(l.d) OVER ()::BIGINT AS inertia,
           sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM last l JOIN c{rounds} c ON c.number = l.number
    """


CENTROIDS_SQL = _centroids()

FILTERS_SQL = r"""
    WITH text AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
      FROM documents
    ), word AS (
      SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM text
    ), cell AS (
      SELECT part,
             (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS cell,
             doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
             doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
      FROM word
    ), total AS (
      SELECT part, cell, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM cell GROUP BY part, cell
    ), letter AS (
      SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(l, bit)
    ), orders AS (
      SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM letter a, letter b, letter c, letter d, letter e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
    ), steps AS (
      SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
      FROM orders CROSS JOIN (SELECT unnest(range(1, 6))::INT AS step)
    ), result AS (
      SELECT part, filter_order, step, own,
             coalesce(sum(n) FILTER (cell & (before | own) = 0), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (cell & before = 0 AND cell & own <> 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (cell & before <> 0 AND cell & own <> 0), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (cell = own), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (cell & before = 0 AND cell & own <> 0), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (cell & before = 0 AND cell & own <> 0), 0)::BIGINT AS toxic_lost
      FROM total CROSS JOIN steps GROUP BY part, filter_order, step, own, before
    )
    SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM result
    """


def _urls(order: int = 5, units: int = 1 << 20, bins: int = 256, most: int = 8192) -> str:
    """The models level by level; thresholds by comparing every edge."""
    kinds = ("a", "b", "af", "bf")
    levels = []
    for k in range(order + 1):
        counted = ", ".join(f"sum({c})::BIGINT AS {c}" for c in kinds)
        totals = ", ".join(f"sum({c}) OVER w AS n_{c}, count(*) FILTER ({c} > 0) OVER w AS f_{c}" for c in kinds)
        shorter = "1.0::DOUBLE / (characters + 1)" if k == 0 else "q.{c}"
        blend = ", ".join(
            f"CASE WHEN n_{c} = 0 THEN {s} ELSE (l.{c} + f_{c} * {s})::DOUBLE / (n_{c} + f_{c}) END AS {c}"
            for c, s in [(c, f"({shorter.format(c=c)})") for c in kinds]
        )
        join = "" if k == 0 else f" JOIN p{k - 1} q ON q.e = right(l.e, {k})"
        levels.append(f"""p{k} AS MATERIALIZED (
      SELECT l.e, {blend} FROM (
        SELECT *, {totals}, count(*) OVER w AS characters FROM (SELECT right(gram, {k + 1}) AS e, {counted} FROM counted GROUP BY 1)
        WINDOW w AS (PARTITION BY left(e, {k}))
      ) l{join})""")
    body = ",\n    ".join(levels)

    def per_bin(total: str) -> str:
        return f"greatest(least(floor(sum({total}) / (count(*) * {units // bins}.0::DOUBLE))::INT, {most}), -{most})"

    def ratio(a: str, b: str) -> str:
        return f"floor((ln({a}) - ln({b})) * {units}.0 + 0.5)::BIGINT"

    return f"""
    WITH page AS (
      SELECT page_id, coalesce(url, '') AS u, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
    ), split AS (
      SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
             translate(coalesce(rest, u), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
      FROM page
    ), ruled AS (
      SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
      FROM split
    ), labelled AS (
      SELECT *, rule IN ('example.net/en/', 'org/fr/') AS allow FROM ruled
    ), urls AS (
      SELECT DISTINCT text, allow FROM labelled
    ), fold AS (
      SELECT text, allow, ('0x' || md5(text)[1:4])::INT % 5 = 0 AS held FROM urls
    ), each AS MATERIALIZED (
      SELECT text, allow, held, unnest([(repeat(chr(1), {order}) || text)[i : i + {order}] for i in range(1, length(text) + 1)]) AS gram FROM fold
    ), counted AS MATERIALIZED (
      SELECT gram, count(*) FILTER (allow) AS a, count(*) FILTER (NOT allow) AS b,
             count(*) FILTER (allow AND NOT held) AS af, count(*) FILTER (NOT allow AND NOT held) AS bf FROM each GROUP BY gram
    ), {body}, known AS (
      SELECT count(*) FILTER (a > 0) > 0 AND count(*) FILTER (b > 0) > 0 AS whole,
             count(*) FILTER (af > 0) > 0 AND count(*) FILTER (bf > 0) > 0 AS part FROM counted
    ), ratios AS (
      SELECT e AS gram, {ratio("a", "b")} AS r, {ratio("af", "bf")} AS rf FROM p{order}
    ), scored AS MATERIALIZED (
      SELECT text, allow, held, CASE WHEN (SELECT whole FROM known) THEN {per_bin("r")} ELSE 0 END AS bin,
             CASE WHEN (SELECT part FROM known) THEN {per_bin("rf")} ELSE 0 END AS bin_fit
      FROM each JOIN ratios USING (gram) GROUP BY text, allow, held
    ), held AS MATERIALIZED (
      SELECT bin_fit AS bin, allow FROM scored WHERE held AND allow IS NOT NULL
    ), worth AS (
      SELECT edge, (SELECT count(*) FROM held WHERE allow AND bin >= edge) * (SELECT count(*) FROM held WHERE NOT allow)
                   + (SELECT count(*) FROM held WHERE NOT allow AND bin < edge) * (SELECT count(*) FROM held WHERE allow) AS v
      FROM (SELECT DISTINCT bin AS edge FROM held)
    ), best AS (
      SELECT min(edge) AS low, max(edge) AS high FROM worth WHERE v = (SELECT max(v) FROM worth)
    ), threshold AS (
      SELECT CASE WHEN (SELECT count(*) FROM held WHERE allow) = 0 OR (SELECT count(*) FROM held WHERE NOT allow) = 0 THEN 0
             ELSE (coalesce((SELECT max(bin) FROM held WHERE bin < low), low - 1) + 1 + high) / 2.0 END AS t FROM best
    )
    SELECT l.page_id, l.host, l.path, l.rule,
           CASE WHEN coalesce(l.allow, coalesce(s.bin, 0) >= (SELECT t FROM threshold)) THEN 'allow' ELSE 'block' END AS verdict
    FROM labelled l LEFT JOIN (SELECT text, bin FROM scored WHERE allow IS NULL) s ON l.allow IS NULL AND s.text = l.text
    """


URLS_SQL = _urls()
