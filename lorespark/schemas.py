"""Declared schemas of the profile tables; nothing is inferred on read."""

PROFILES = "profile_id BIGINT, rid STRING, slug STRING, document STRING, content_hash STRING, name STRING, level STRING, provenance STRING, affiliation STRING, affiliation_id STRING, email STRING, field STRING, summary STRING, visibility STRING, date_modified STRING, subfields ARRAY<STRING>, expertise ARRAY<STRING>, interests ARRAY<STRING>, not_interests ARRAY<STRING>"
PAPERS = "profile_id BIGINT, ordinal INT, record STRING, paper_id STRING, title STRING, year INT, journal STRING, authors ARRAY<STRING>, doi STRING, pmid STRING, pmcid STRING, openalex_id STRING, author_position STRING, is_corresponding BOOLEAN, cited_by_count INT, abstract STRING, summary STRING, topics ARRAY<STRING>"
SEED_PAPERS = "profile_id BIGINT, ordinal INT, name STRING, year INT, openalex_id STRING, doi STRING, abstract STRING, topics ARRAY<STRING>, added_at TIMESTAMP, added_via STRING"
GRANTS = "profile_id BIGINT, ordinal INT, grant_id STRING, title STRING, funder STRING, number STRING, activity_code STRING, role STRING, status STRING, start STRING, `end` STRING, source STRING"
TRIALS = "profile_id BIGINT, nct_id STRING, title STRING, researcher_role STRING, phase STRING, status STRING, conditions ARRAY<STRING>, sponsor_type STRING, enrollment INT, sites INT"
ARTIFACTS = "profile_id BIGINT, content_url STRING, manifest_slot STRING, ordinal INT, role STRING, paper_id STRING, visibility STRING, derived_from ARRAY<STRING>, sha256 STRING, size_bytes BIGINT, inputs_digest STRING"
INTERESTS = "profile_id BIGINT, ordinal INT, system STRING, code STRING, label STRING, weight DOUBLE, method STRING, asserted_at TIMESTAMP, share DOUBLE"
CHUNKS = "profile_id BIGINT, source_type STRING, source_id STRING, chunk_index INT, section STRING, text STRING, embed_text STRING, text_hash STRING, char_count INT"
CHUNK_VECTORS = "profile_id BIGINT, source_type STRING, source_id STRING, chunk_index INT, dim INT, backend_spec STRING, vector ARRAY<FLOAT>"
PROFILE_VECTORS = "profile_id BIGINT, kind STRING, dim INT, backend_spec STRING, vector ARRAY<FLOAT>"
NODES = "key STRING, kind STRING, rid STRING, slug STRING, name STRING"
EDGES = "src STRING, dst STRING, type STRING, directed BOOLEAN, confidence STRING, paper_count INT, first_year INT, last_year INT, institution STRING, overlap_years BOOLEAN, evidence ARRAY<STRING>"

TABLES = {"profiles": PROFILES, "papers": PAPERS, "seed_papers": SEED_PAPERS, "grants": GRANTS, "trials": TRIALS, "artifacts": ARTIFACTS, "interests": INTERESTS, "chunks": CHUNKS, "chunk_vectors": CHUNK_VECTORS, "profile_vectors": PROFILE_VECTORS, "graph_nodes": NODES, "graph_edges": EDGES}
