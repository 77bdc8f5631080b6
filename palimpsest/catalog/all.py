"""Import every catalog module so that its queries register."""

from palimpsest.catalog import chunks, detect, graph, kg, load, log, retrieval, streams, tasks, text  # noqa: F401
