"""Closed sets of names that decide what is text, a block, or apparatus."""

# Elements that make a line of their own unless a stylesheet says otherwise.
BLOCK_TAGS = tuple(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Displays that make a block.
BLOCK_DISPLAYS = ("block", "flex", "grid", "table", "table-row", "table-cell", "list-item", "flow-root")
# Elements whose text is never content; ruby annotations; elements excluded unless asked for.
NON_CONTENT_TAGS = ("script", "style", "head", "title", "template", "svg", "math")
RUBY_TAGS = ("rt", "rp", "rtc")
EXCLUDED_TAGS = ("sup", "code")
# What marks a note, which is shown although it is hidden.
NOTE_TYPES = ("footnote", "endnote", "rearnote", "note", "footnotes", "endnotes")
NOTE_ROLES = ("doc-footnote", "doc-endnote")
# Elements without an end tag.
VOID_TAGS = tuple("area base br col embed hr img input link meta param source track wbr".split())
#: Headings are never in doubt.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
