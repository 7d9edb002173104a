"""Refusals: each is raised while a plan is built or at a gate, never swallowed."""


class Refusal(ValueError):
    """Base of all refusals."""


class TransformDomainError(Refusal):
    """A price outside a transform's domain."""


class DataUnavailableError(Refusal):
    """No source could answer."""


class StaleDataError(Refusal):
    """A series that blocks publication is too old."""


class ScheduleError(Refusal):
    """A schedule without provenance or out of order."""


class RouteError(Refusal):
    """A route book that contradicts itself."""


class InsufficientDataError(Refusal):
    """Fewer observations than a model needs."""


class DeterministicVarianceError(Refusal):
    """A model without per-path variance asked for a leveraged answer."""


class OverlappingWindowsError(Refusal):
    """A p-value asked for on overlapping windows."""


class NonFiniteLossError(Refusal):
    """A model whose losses are not finite."""


class MixedDriftPolicyError(Refusal):
    """Models of different drift policies in one comparison."""


class DesignError(Refusal):
    """A factor design that cannot be built."""


class ProjectionError(Refusal):
    """A local projection with too few rows."""


class ElapsedForecastError(Refusal):
    """A forecast that may no longer be overwritten."""
