"""DuckDB SQL for the queries that SQL can express on whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def _near(width: int, also: str) -> str:
    """Links by all pairs that share a shingle of ``width`` words, components by reach."""
    return rf"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i+{width - 1}], ' ')) END) AS s FROM words),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
  pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS (SELECT u, v FROM pairs JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
  edges AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
  reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.u, edges.v FROM reach JOIN edges ON edges.u = reach.v),
  parts AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id{also} FROM documents d JOIN parts USING (doc_id) LEFT JOIN sizes USING (doc_id)"""


NEAR_DUPS = _near(5, ", d.doc_id = component_id AS kept")
NGRAM_JOIN = _near(4, "")

WARC = r"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
  k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keeper, regexp_replace(url, '(?s)^.*?://', '') AS rest FROM p),
  u AS (SELECT *, regexp_extract(rest, '^[^/?#]*', 0) AS host, regexp_extract(rest, '^[^/?#]*/?([^#]*)', 1) AS tail, regexp_matches(rest, '^[^/?#]*/') AS slash FROM k),
  o AS (SELECT *, array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || CASE WHEN slash THEN '/' || tail WHEN tail = '' THEN '/' ELSE tail END AS url_key, strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM u)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to, url_key, timestamp, row_number() OVER (ORDER BY url_key, timestamp, page_id) - 1 AS capture_order FROM o"""

URLS = rf"""WITH h AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
  rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
  hits AS (SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC, v = 'block' DESC) AS r FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT h.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM h LEFT JOIN hits ON hits.page_id = h.page_id AND r = 1"""


def _least(nodes: list[tuple[str, int]]) -> str:
    """Name of the child with the least draw; ``nodes``: (name, weight)."""
    names = ", ".join(f"'{n}'" for n, _ in nodes)
    draws = ", ".join(f"-ln((CAST(CAST('0x' || substr(md5(doc_id || '/{n}'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / {w}.0" for n, w in nodes)
    return f"[{names}][list_position([{draws}], list_min([{draws}]))]"


def _descent(shards: int, name: str, source: str, laid: int) -> str:
    """CTEs that take each row of ``source`` from the root to a region, a rack and a shard of the even tree; shards from ``laid`` on hang on the root."""
    def below(node: str, node_of: dict[int, str], all_of: dict[int, str]) -> list[tuple[str, int]]:
        held = {n: 0 for i, n in node_of.items() if all_of[i] == node}
        for i, n in node_of.items():
            if all_of[i] == node:
                held[n] += 1
        return sorted(held.items())

    whole = {i: f"{i // 4}/{i // 2}/{i}" for i in range(shards)}
    levels = [{i: "" for i in range(shards)}, *[{i: "/".join(w.split("/")[: k if i < laid else 3]) for i, w in whole.items()} for k in (1, 2, 3)]]
    out, last = [], source
    for k in (1, 2, 3):
        at = f"{name}{k}"
        cases = " ".join(f"WHEN '{n}' THEN {_least(below(n, levels[k], levels[k - 1]))}" for n in dict.fromkeys(levels[k - 1].values()))
        out.append(f"{at} AS (SELECT doc_id, CASE {'node' if k > 1 else chr(39) * 2} {cases} END AS node FROM {last})")
        last = at
    return ", ".join(out) + f", {name} AS (SELECT doc_id, CAST(split_part(node, '/', 1) AS INTEGER) AS region, CAST(split_part(node, '/', 2) AS INTEGER) AS rack, CAST(split_part(node, '/', 3) AS INTEGER) AS shard FROM {last})"


SHARDS = f"""WITH crc_table AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
  body AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  bytes AS (SELECT doc_id, length(h) // 2 AS n, list_transform(range(length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)) AS l FROM body),
  facts AS (SELECT doc_id, CAST(n + 1 AS BIGINT) AS size, xor(list_reduce(list_concat([4294967295], l), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS text_crc32 FROM bytes, crc_table),
  {_descent(8, 'now_', 'documents', 8)}, {_descent(9, 'later', 'documents', 8)}
SELECT doc_id, size, text_crc32, 'key' AS law, now_.shard, row_number() OVER (PARTITION BY now_.shard ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 3), doc_id) - 1 AS slot, later.shard AS grown_shard, now_.region, now_.rack FROM facts JOIN now_ USING (doc_id) JOIN later USING (doc_id)"""

def _merge_level(k: int) -> str:
    """CTEs that put the units of two nodes into one order by their deadlines, and time the merged order."""
    return f"""p{k} AS (SELECT source, unit, seat >> {k + 1} AS node, seat, row_number() OVER (PARTITION BY seat >> {k + 1} ORDER BY round(time, 8), (seat >> {k}) & 1, pos) - 1 AS pos FROM u{k}),
  b{k} AS (SELECT seat >> {k + 1} AS node, n / w AS ends, sum(n) OVER o AS due, coalesce(sum(w) OVER (PARTITION BY seat >> {k + 1} ORDER BY n / w, seat ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rate, sum(w) OVER (PARTITION BY seat >> {k + 1}) AS whole FROM s WINDOW o AS (PARTITION BY seat >> {k + 1} ORDER BY n / w, seat ROWS UNBOUNDED PRECEDING)),
  v{k} AS (SELECT p.source, p.unit, max(due + ends * rate) AS reached, arg_max(due, due + ends * rate) AS due, arg_max(rate, due + ends * rate) AS rate FROM p{k} p JOIN b{k} b ON b.node = p.node AND b.due + b.ends * b.rate < p.pos + 1 - 1e-9 GROUP BY 1, 2),
  u{k + 1} AS MATERIALIZED (SELECT p.source, p.unit, p.seat, p.pos, CASE WHEN v.source IS NULL THEN (p.pos + 1) / w.whole WHEN v.rate > 0 THEN (p.pos + 1 - v.due) / v.rate ELSE 1e300 END AS time FROM p{k} p LEFT JOIN v{k} v ON v.source = p.source AND v.unit = p.unit JOIN (SELECT DISTINCT node, whole FROM b{k}) w ON w.node = p.node)"""


#: Six levels of the tree hold 64 sources, three times as many as the tables have.
MIXTURE = f"""WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS key FROM documents), c AS (SELECT key AS source, count(*) AS rows, sqrt(CAST(count(*) AS DOUBLE)) AS w FROM d GROUP BY 1),
  q AS (SELECT CASE WHEN count(*) > 1 THEN CAST(ceil(log2(count(*))) AS BIGINT) ELSE 0 END AS levels FROM c), z AS (SELECT levels, greatest(1, 32 // (levels + 1)) AS rows_ FROM q),
  s AS (SELECT source, w, row_number() OVER (ORDER BY w DESC, source) - 1 AS seat, (rows + rows_ - 1) // rows_ AS n FROM c, z),
  u0 AS (SELECT source, unit, seat, unit AS pos, (unit + 1) / w AS time FROM (SELECT *, unnest(range(n)) AS unit FROM s)),
  {", ".join(map(_merge_level, range(6)))},
  r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank FROM d)
SELECT doc_id, r.source, rank // (rows_ * (levels + 1)) AS block, pos AS slot, pos * rows_ + rank % rows_ AS place FROM r, z JOIN u6 ON u6.source = r.key AND u6.unit = rank // rows_"""

def _stated(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_stated, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


def _hash_tree(name: str, leaves: str) -> str:
    """CTEs of a binary hash tree over ``leaves`` (g, pos, h, n): nodes, siblings and their proofs, tops."""
    return f"""{name}(lvl, g, pos, h, n) AS (SELECT 0, g, pos, h, n FROM {leaves} UNION ALL SELECT lvl + 1, g, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY lvl, g, pos // 2, n),
  {name}_side AS (SELECT a.lvl, a.g, a.pos, coalesce(b.h, '') AS h FROM {name} a LEFT JOIN {name} b ON b.lvl = a.lvl AND b.g = a.g AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
  {name}_top AS (SELECT g, h, lvl FROM {name} WHERE n = 1)"""


MERKLE = f"""WITH RECURSIVE crc_table AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
  d AS (SELECT doc_id, coalesce('s' || lang, '') AS g, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + 1)")} AS bent,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 7 = 0 AS hit FROM documents, crc_table),
  placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d), leaves AS (SELECT g, pos, leaf AS h, n FROM placed),
  {_hash_tree("low", "leaves")}, crowns AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, count(*) OVER () AS n, g AS lang FROM low_top), {_hash_tree("high", "crowns")},
  steps AS (SELECT p.doc_id, s.lvl, s.h, (p.pos >> s.lvl) & 1 AS digit FROM placed p JOIN low_side s ON s.g = p.g AND s.pos = p.pos >> s.lvl
    UNION ALL SELECT p.doc_id, 1000 + s.lvl, s.h, (c.pos >> s.lvl) & 1 FROM placed p JOIN crowns c ON c.lang = p.g JOIN high_side s ON s.pos = c.pos >> s.lvl),
  sides AS (SELECT doc_id, list(struct_pack(h := h, digit := digit) ORDER BY lvl) AS way FROM steps GROUP BY 1),
  folded(doc_id, k, h) AS (SELECT doc_id, 1, CASE WHEN hit THEN bent ELSE leaf END FROM placed UNION ALL SELECT f.doc_id, k + 1, sha256(CASE WHEN way[k].digit = 1 THEN way[k].h || f.h ELSE f.h || way[k].h END) FROM folded f JOIN sides USING (doc_id) WHERE k <= len(way)),
  reached AS (SELECT doc_id, arg_max(h, k) AS folded_root FROM folded GROUP BY 1)
SELECT p.doc_id, p.leaf, t.h AS subroot, r.h AS root, sha256(coalesce(array_to_string(list_transform(way, lambda s: s.h), ''), '')) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM placed p JOIN low_top t ON t.g = p.g CROSS JOIN high_top r LEFT JOIN sides USING (doc_id) JOIN reached USING (doc_id)"""

def _clustered() -> str:
    """Three rounds and a last assignment; centroids keep their numbers and empty ones their place."""
    apart = "list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))"
    parts = []
    for r in range(4):
        parts.append(f"m{r} AS (SELECT k.vec_id, k.row, k.v, c.j, {apart} AS d FROM kept k, c{r} c), a{r} AS (SELECT vec_id, row, any_value(v) AS v, CAST(arg_min(j, struct_pack(d := d, j := j)) AS INTEGER) AS j, CAST(min(d) AS BIGINT) AS d FROM m{r} GROUP BY vec_id, row)")
        if r < 3:
            parts.append(f"t{r} AS (SELECT j, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) x(i) GROUP BY 1, 2), n{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM t{r} GROUP BY 1), c{r + 1} AS (SELECT c.j, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} n USING (j))")
    return ", ".join(parts)


CLUSTERS = f"""WITH kept AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS row, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j, v FROM kept QUALIFY j < 16), {_clustered()},
  f AS (SELECT j, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM c3)
SELECT vec_id, a3.j AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a3.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a3 JOIN f ON f.j = a3.j"""

ORACLES = {"op13_ngram_jaccard_join": NGRAM_JOIN, "op11_subvector_clusters": CLUSTERS, "op12_merkle_manifest": MERKLE, "op4_mix_sources": MIXTURE, "op3_minhash_near_dups": NEAR_DUPS, "op5_warc_index": WARC, "op9_url_filters": URLS, "op10_hash_tree_shards": SHARDS}
