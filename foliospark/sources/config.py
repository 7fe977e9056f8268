"""Settings from a YAML file, with overrides from the environment."""

import copy
import os
from pathlib import Path

#: Environment variables and the settings they replace.
OVERRIDES = {
    "RAG_PERSIST_DIR": ("paths", "persist_dir"),
    "RAG_CHUNK_DIR": ("paths", "chunk_dir"),
    "RAG_EVAL_RESULTS_DIR": ("paths", "eval_results_dir"),
    "RAG_COLLECTION_NAME": ("vector_store", "collection_name"),
    "RAG_MANIFEST_PATH": ("paths", "manifest_path"),
    "RAG_BM25_INDEX_DIR": ("paths", "bm25_index_dir"),
    "RAG_EMBEDDING_MODEL": ("models", "embedding"),
    "RAG_RERANKER_MODEL": ("models", "reranker"),
}
DEFAULTS = {
    "paths": {},
    "chunking": {"target_size": 900, "overlap_size": 75},
    "retrieval": {"top_k": 4, "preview_chars": 300, "candidate_k": 12, "bm25_k": 8, "dense_k": 8, "hybrid_alpha": 0.6},
    "evaluation": {"top_k": 3, "candidate_k": 8},
}


def load(path: str | None = None, project: str = ".", environ: dict | None = None) -> dict:
    """Defaults, then the file, then the environment; relative paths are of the project."""
    environ = os.environ if environ is None else environ
    settings = copy.deepcopy(DEFAULTS)
    if path is not None:
        import yaml

        file = Path(path)
        if not file.is_file():
            raise FileNotFoundError(f"no settings at {file}")
        given = yaml.safe_load(file.read_text("utf-8")) or {}
        if not isinstance(given, dict):
            raise ValueError("settings have to be a mapping")
        for section, values in given.items():
            settings[section] = (settings.get(section) or {}) | values if isinstance(values, dict) else values
    for name, (section, key) in OVERRIDES.items():
        if environ.get(name):
            settings.setdefault(section, {})[key] = environ[name]
    for key, value in settings["paths"].items():
        if value:
            p = Path(value).expanduser()
            settings["paths"][key] = p if p.is_absolute() else Path(project) / p
    return settings
