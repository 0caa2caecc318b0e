"""Errors a caller can tell apart."""


class LoamError(Exception):
    """Base of all errors raised on purpose."""


class ParseError(LoamError):
    """A document whose head can't be read."""


class FilterError(LoamError):
    """An unknown predicate, or a wrong operand for one."""


class QueryError(LoamError):
    """A filter text or query option that makes no sense."""


class PatternError(QueryError):
    """A graph pattern that makes no sense."""


class PatternUnsupported(PatternError):
    """A known construct of pattern languages that isn't offered."""


class EditError(LoamError):
    """An edit that can't be applied."""


class SearchError(LoamError):
    """Base of search errors."""


class BackendNotFound(SearchError):
    pass


class BackendUnavailable(SearchError):
    pass


class BackendKindError(SearchError):
    pass


class IndexVersionError(SearchError):
    pass
