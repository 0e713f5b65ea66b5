"""preftable: preference-tuning data preparation and rollout arithmetic as Spark jobs.

Layout
------
- ``functions``  column functions (``Column`` in, ``Column`` out); no shuffles.
- ``operators``  table functions (``DataFrame`` in, ``DataFrame`` out).
- ``sources``    readers and sinks (JSON, text, Parquet).
- ``plans``      views over the driver fixture tables and the registered queries.
- ``streaming``  Structured Streaming variants of the stateless and windowed operators.
"""

from preftable.config import (  # noqa: F401
    IGNORE_INDEX,
    PROMPT_TEMPLATES,
    SpecialIds,
)
