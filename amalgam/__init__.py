"""Spark-native record deduplication and corpus preparation."""

__version__ = "0.1.0"
__all__ = ["CanonicalRecord", "ParseError", "dedupe", "normalize", "parse_file", "parse_folder", "write_jsonl"]


def __getattr__(name: str) -> object:
    # on demand, so that Python workers, which need single modules, start fast
    if name == "normalize":
        from amalgam.operators.normalize import normalize

        return normalize
    if name == "CanonicalRecord":
        from amalgam.records import CanonicalRecord

        return CanonicalRecord
    if name in __all__:
        from amalgam import api

        return getattr(api, name)
    raise AttributeError(name)
