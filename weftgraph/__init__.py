"""Provenance graphs of machine-learning experiments as Spark DataFrames."""

__version__ = "0.1.0"
__all__ = ["CorpusConfig", "CorpusGenerator", "ProvDocumentBuilder", "ProvValidator", "ValidationResult"]


def __getattr__(name: str):
    """The public classes, imported when first asked for: Python workers need none of them."""
    if name in __all__:
        from weftgraph import api

        return getattr(api, name)
    raise AttributeError(name)
