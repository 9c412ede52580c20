"""Operators for preparing training corpora. Nothing else in the library imports this package."""

import pyarrow as pa

# Arrow's own pool keeps freed memory; Python workers live on between tasks, beside their executor's heap.
pa.set_memory_pool(pa.system_memory_pool())
