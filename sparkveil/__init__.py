"""Find sensitive entities in documents, act on them under policies, keep an audit trail; on Spark."""

from importlib import import_module

#: Public names by module; loaded on first use, so that workers load only what they run.
_NAMES = {
    "engine": ("Engine", "documents"),
    "errors": ("VeilError",),
    "functions.crypto": ("KeyProvider",),
    "operators.media": ("Reader",),
    "operators.recognizers": ("Dictionary", "Pattern", "Recognizer"),
    "plans.decide": ("Override",),
    "plans.policy": ("AnalyzerParams", "Attribution", "Label", "LabelEntry", "ModalityRedactions", "Policy", "Predicate", "RasterMode", "Redaction", "Rule", "Scope", "ScopeParams", "TemplateOrigin"),
}
_MODULE = {name: module for module, names in _NAMES.items() for name in names}
__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name in _MODULE:
        return getattr(import_module(f"{__name__}.{_MODULE[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
