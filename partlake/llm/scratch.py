"""The scratch tables of ``partlake/scratch.py`` under this subpackage's name."""

from partlake.scratch import Scratch, scratch_root  # noqa: F401
