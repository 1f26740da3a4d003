"""The role views again, as SQL for the oracle; ``with_views(body)`` puts the ones that ``body`` names before it."""

from __future__ import annotations

import re

VIEWS = {
    "files": """SELECT doc_id AS id, source || '/' || lang AS snapshot_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, n_chars AS size,
 CASE WHEN doc_id % 7 = 0 THEN 'text/markdown' ELSE 'text/plain' END AS content_type, sha256(text) AS content_hash, lang AS language,
 CASE doc_id % 5 WHEN 1 THEN 'unknown' WHEN 2 THEN 'code' WHEN 3 THEN 'tests' WHEN 4 THEN 'architecture' END AS domain, doc_id AS created_at, text AS content FROM documents""",
    "snapshots": """SELECT source || '/' || lang AS id, source AS source_id, lang AS version_identifier, lang <> 'de' AS indexed,
 CASE WHEN lang <> 'es' THEN max(doc_id) END AS indexed_at, max(doc_id) AS created_at FROM documents GROUP BY source, lang""",
    "sources": """SELECT DISTINCT source AS id, CAST(substr(source, 4) AS INT) % 3 AS product_id, source AS name,
 CASE WHEN CAST(substr(source, 4) AS INT) % 4 = 0 THEN 'local' ELSE 'git' END AS source_type, CAST(substr(source, 4) AS INT) AS created_at FROM documents""",
    "products": "SELECT r_regionkey AS id, r_name AS name, r_regionkey + 100 AS created_at FROM region",
    "wiki": "SELECT n_nationkey AS id, n_regionkey AS product_id, '/wiki/' || n_name AS output_path, n_nationkey + 4 AS generated_at FROM nation WHERE n_nationkey % 5 = 0",
    "git_refs": "SELECT 'ref-' || id AS id, source_id, version_identifier AS ref_name, id AS snapshot_id FROM snapshots",
    "vectors": "SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS vector, label AS model FROM embeddings",
    "q": "SELECT embedding::DOUBLE[] AS qv, label AS ql FROM embeddings WHERE vec_id = 0",
    "chunks": """SELECT conv_id * 1000 + turn AS id, conv_id AS file_id, turn AS ordinal, role AS chunk_type, text AS content, sha256(text) AS content_hash,
 ceil(length(text) / 4.0)::INT AS token_count, CASE WHEN turn % 3 = 0 THEN NULL ELSE (turn % 5) / 10.0 END::DOUBLE AS comment_ratio,
 CASE WHEN turn % 4 = 3 THEN NULL ELSE turn + 1 END AS cyclomatic_complexity, turn % 4 <> 2 AS is_latest,
 CASE WHEN conv_id % 3 <> 0 THEN sha1(conv_id::VARCHAR) END AS git_commit_hash, (DATE '2024-01-01' + (conv_id % 60)::INT)::TIMESTAMP AS indexed_at, turn AS created_at FROM conversations""",
    "hierarchy": """SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child, n_nationkey::BIGINT AS ordinal FROM nation
 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey FROM customer""",
    "chain": "SELECT conv_id * 1000 + turn - 1 AS parent, conv_id * 1000 + turn AS child, 0::BIGINT AS ordinal FROM conversations WHERE turn > 0",
    "dependencies": "SELECT l_orderkey AS from_id, l_partkey AS to_id, l_returnflag AS dep_type, CASE WHEN l_linenumber <> 1 THEN l_linestatus END AS symbol, l_shipdate AS created_at FROM lineitem",
    "snapshot_files": """SELECT f.id, split_part(f.path, '/', 1) AS snapshot_id,
 CASE WHEN f.id % 11 = 0 THEN language || '/docs/adr/' || f.id WHEN f.id % 13 = 0 THEN path || '/readme.MD' ELSE path END AS file_path,
 size AS file_size, domain, l.doc_id IS NOT NULL AS indexed FROM files f LEFT JOIN labels l ON l.doc_id = f.id""",
    "summaries": """SELECT id, snapshot_id, CASE id % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'directory' ELSE 'architecture' END AS summary_type,
 CASE WHEN id % 3 = 2 THEN '' ELSE path END AS target_path, CASE WHEN id % 3 = 1 THEN (id % 6)::INT END AS depth,
 CASE WHEN id % 3 = 2 THEN ['overview', 'tech_stack', 'data_flow', 'components'][id % 4 + 1] END AS arch_type, content, content_hash, created_at FROM files""",
    "commits": "SELECT 'u' || user_id || '.go' AS path, sha1(event_id::VARCHAR) AS hash, event_type AS author, ts, event_id FROM events",
    "latest": """SELECT id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY indexed_at DESC NULLS LAST, created_at DESC NULLS LAST, id) AS rn
 FROM snapshots WHERE indexed) WHERE rn = 1""",
    "scored": "SELECT chunk_id, vector, model, round(list_cosine_similarity(vector, qv), 6) AS score FROM vectors, q",
}


def with_views(body: str) -> str:
    need: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in need and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                add(VIEWS[name])
                need.append(name)

    add(body)
    rest = body.strip()
    head = "WITH RECURSIVE " if need or rest.upper().startswith("WITH") else ""
    if rest.upper().startswith("WITH RECURSIVE"):
        rest = rest[len("WITH RECURSIVE") :].strip()
        return head + "".join(f"{n} AS ({VIEWS[n]}),\n" for n in need) + rest
    if rest.upper().startswith("WITH"):
        rest = rest[len("WITH") :].strip()
        return head + "".join(f"{n} AS ({VIEWS[n]}),\n" for n in need) + rest
    return head + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in need) + ("\n" if need else "") + rest
