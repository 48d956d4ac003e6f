"""Tables that outlive a stage; see ``assayer.sources.shared``."""

from assayer.sources.shared import CLEANUP, shared_dir, shared_path, table

__all__ = ["CLEANUP", "shared_dir", "shared_path", "table"]
