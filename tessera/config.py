"""Defaults of the retrieval engine."""

#: Fusion: 0-based ranks, so k is added to them as they are.
RRF_K, VECTOR_WEIGHT, KEYWORD_WEIGHT, REASONING_WEIGHT = 60, 0.6, 0.4, 2.0
#: Keyword-tilted weights for short queries that look like code.
TILTED = (0.3, 0.7)
BM25_K1, BM25_B = 1.2, 0.75
TOP_K, MAX_QUERIES = 10, 10
#: Graph expansion: seed blocks, neighbour files and blocks per file.
SEEDS, EXPAND_FILES, EXPAND_BLOCKS = 10, 8, 3
#: Chunking: bytes per text chunk and overlapping lines.
CHUNK_BYTES, OVERLAP_LINES, MARKDOWN_BASE = 2000, 100, 2000
DIFF_BYTES, DIFF_OVERLAP, DIFF_CHUNKS = 8000, 200, 50
MAX_PATHS, MAX_FILE_BYTES = 20, 5 << 20
TOKEN_CLASS = r"[\p{L}\p{N}_]+"
