"""Where intermediate tables go; the same folder as for the rest of the library."""

from legispark.storage import drop, materialize, partitions_for, shared_folder  # noqa: F401
