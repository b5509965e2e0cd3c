"""Column expressions: slugs, frontmatter, body, timeline, wikilinks, rendering."""
