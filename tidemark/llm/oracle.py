"""SQL twins of the named queries, for DuckDB."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from tidemark.llm.bitslice import K, SCALE
from tidemark.llm.chat import BREAK, CLOSE, LEARNED, OPEN
from tidemark.llm.mixing import MOST, SEED, SHARE, WEIGHTS
from tidemark.llm.packing import BUCKETS, BUDGET
from tidemark.llm.shards import SHARDS

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

def _packing() -> str:
    layers = ["l1 AS (SELECT j, len * n - s AS cost, 0 AS prev FROM h)"]
    for k in range(2, BUCKETS + 1):
        layers.append(
            f"l{k} AS (SELECT j, cost, prev FROM (SELECT b.j, a.cost + b.len * (b.n - p.n) - (b.s - p.s) AS cost, a.j AS prev, "
            "row_number() OVER (PARTITION BY b.j ORDER BY a.cost + b.len * (b.n - p.n) - (b.s - p.s), a.j) AS pick "
            f"FROM h b JOIN l{k - 1} a ON a.j < b.j JOIN h p ON p.j = a.j) WHERE pick = 1)"
        )
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM l{k}" for k in range(1, BUCKETS + 1))
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, ({WORDS} + 1)::BIGINT AS n_tokens FROM documents),
    g AS (SELECT n_tokens AS len, count(*)::BIGINT AS c FROM d WHERE n_tokens <= {BUDGET} GROUP BY 1),
    h AS (SELECT row_number() OVER (ORDER BY len) AS j, len, (sum(c) OVER (ORDER BY len))::BIGINT AS n,
          (sum(c * len) OVER (ORDER BY len))::BIGINT AS s FROM g),
    {", ".join(layers)},
    every AS ({every}),
    path AS (
        SELECT * FROM (SELECT k, j, prev FROM every WHERE j = (SELECT max(j) FROM h) ORDER BY cost, k LIMIT 1)
        UNION ALL SELECT e.k, e.j, e.prev FROM path p JOIN every e ON e.k = p.k - 1 AND e.j = p.prev
    ),
    bounds AS (SELECT row_number() OVER (ORDER BY len) - 1 AS bucket, len FROM path JOIN h USING (j)),
    put AS (SELECT doc_id, n_tokens,
            (SELECT count(*) FROM bounds b WHERE b.len < n_tokens) AS bucket,
            coalesce((SELECT min(b.len) FROM bounds b WHERE b.len >= n_tokens), n_tokens) AS bucket_len FROM d),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, n_tokens) - 1 AS r,
               greatest(1, {BUDGET} // bucket_len) AS fit FROM put)
    SELECT doc_id, n_tokens, bucket::INT AS bucket, bucket_len, r // fit AS batch, (r % fit)::INT AS slot FROM ranked
    """


def _mixing() -> str:
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return f"""
    WITH d AS (SELECT doc_id, source, {WORDS}::BIGINT AS size FROM documents),
    sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
    caps AS (SELECT *, {MOST} * source_size AS cap,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {weight} END AS weight FROM sized),
    levels AS (SELECT *, ({SHARE}::DOUBLE * (sum(source_size) OVER ())
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS own FROM caps),
    cut AS (SELECT *, max(CASE WHEN cap / weight > own THEN own END) OVER () AS level FROM levels),
    targets AS (SELECT source, source_size,
                (CASE WHEN cap / weight > level THEN level * weight ELSE cap END)::DOUBLE AS target FROM cut),
    placed AS (SELECT d.doc_id, d.size, t.source_size, t.target,
               CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0::DOUBLE END AS each,
               ('0x' || substr(md5('{SEED}:' || (d.source IS NULL)::VARCHAR || ':' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start,
               row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS r
               FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           ((floor(start + each * (r + 1)) - floor(start + each * r)) * size)::BIGINT AS taken FROM placed
    """


def _chat() -> str:
    return f"""
    WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, t.turn, t.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM c),
    f AS (SELECT *, {len(OPEN) + len(BREAK) + len(CLOSE)} + len(role) + len(text) + len(regexp_extract_all(text, '[<\\[\\\\]')) AS whole FROM n)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
           coalesce(sum(len(text)) FILTER (WHERE role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = '{LEARNED}'), '')) AS loss_sha256,
           sum(whole)::BIGINT AS formatted_chars
    FROM f GROUP BY conv_id
    """


def _search() -> str:
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS ints FROM embeddings
               WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.ints::DOUBLE[], c.ints::DOUBLE[])::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.ints) = len(c.ints) WHERE q.vec_id % 100 = 0),
    r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
    SELECT * FROM r WHERE rank <= {K}
    """


def _duplicates(width: int, percent: int) -> str:
    joined = " || ' ' || ".join(f"words[i + {k}]" for k in range(width))
    return rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'),
                         '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {width} THEN [array_to_string(words, ' ')]
          ELSE list_transform(range(1, len(words) - {width - 2}), lambda i: {joined}) END)) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
    m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
    FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
    """


def _shards() -> str:
    # The table of remainders of the checksum, and one step per byte.
    table = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i))"
    return f"""
    WITH t AS (SELECT {table} AS crc),
    d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
          xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
              lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM documents, t),
    p AS (SELECT *, (coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          * {SHARDS} // (sum(size) OVER ()))::INT AS shard FROM d)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
           NULL::INT AS grown_shard FROM p
    """


def _audit() -> str:
    return r"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
          regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    least AS (SELECT text, min(doc_id) AS least FROM d GROUP BY 1),
    marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
    fails AS (SELECT d.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
          CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
          || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
          || CASE WHEN 100 * len(regexp_extract_all(d.text, '[A-Z]')) > 2 * length(d.text) THEN 'C' ELSE '' END
          || CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END
          || CASE WHEN d.doc_id > least THEN 'E' ELSE '' END AS failed
          FROM d JOIN least USING (text) LEFT JOIN marks ON marks.doc_id = d.doc_id),
    g AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM fails GROUP BY 1, 2),
    orders AS (SELECT '' AS o UNION ALL SELECT o || c FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t(c) WHERE NOT contains(o, c)),
    steps AS (SELECT o AS filter_order, i::INT AS step, o[i] AS f, o[1:i - 1] AS ahead FROM orders, range(1, 6) r(i) WHERE length(o) = 5),
    figures AS (SELECT part, filter_order, step, f,
          sum(n) FILTER (WHERE failed = '' OR translate(failed, ahead || f, '') = failed) AS kept,
          sum(n) FILTER (WHERE contains(failed, f) AND translate(failed, ahead, '') = failed) AS removed,
          sum(n) FILTER (WHERE contains(failed, f) AND translate(failed, ahead, '') <> failed) AS redundant,
          sum(n) FILTER (WHERE failed = f) AS unique_fails,
          sum(good) FILTER (WHERE contains(failed, f) AND translate(failed, ahead, '') = failed) AS good_lost,
          sum(toxic) FILTER (WHERE contains(failed, f) AND translate(failed, ahead, '') = failed) AS toxic_lost
          FROM g, steps GROUP BY 1, 2, 3, 4)
    SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
           coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
           coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
           (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM figures
    """


SQL: dict[str, str] = {
    "op1_length_buckets": _packing(),
    "op3_bit_sliced_search": _search(),
    "op5_bottom_k_duplicates": _duplicates(3, 85),
    "op6_reply_paths": _chat(),
    "op7_byte_shards": _shards(),
    "op8_systematic_mix": _mixing(),
    "op12_filter_audit": _audit(),
}
