"""All registered queries; importing a module registers its own."""

from epiweave.plans.registered import (  # noqa: F401
    aggregations,
    capacity,
    dimensions,
    forecasts,
    ingest,
    ordered,
    samples,
    snapshots,
    streams,
    texts,
)
