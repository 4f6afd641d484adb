"""Column expressions (JVM-side, no Python per row)."""

from . import dates, frontmatter, links, metadata, prompts, replies, text  # noqa: F401
