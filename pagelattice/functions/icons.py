"""A small catalogue of icons as SVG text, drawn from simple strokes on a 24 x 24 grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import clean_hex
from .layout import icon_key
from .text import escaped_xml, svg_data_uri, text_or_empty

#: Own stroke paths; a name without one is drawn as application.
STROKES = {
    "analytics": "M4 20V12M10 20V6M16 20V9M21 20H3",
    "business": "M8 8a3 3 0 1 0 6 0a3 3 0 1 0-6 0M4 20c1-6 13-6 14 0",
    "application": "M4 4h7v7H4zM13 4h7v7h-7zM4 13h7v7H4zM13 13h7v7h-7z",
    "database": "M5 6c0-3 14-3 14 0v12c0 3-14 3-14 0zM5 6c0 3 14 3 14 0M5 12c0 3 14 3 14 0",
    "ai": "M7 7h10v10H7zM10 3v4M14 3v4M10 17v4M14 17v4M3 10h4M3 14h4M17 10h4M17 14h4",
    "server": "M4 5h16v6H4zM4 13h16v6H4zM7 8h1M7 16h1",
    "customer": "M9 7a3 3 0 1 0 6 0a3 3 0 1 0-6 0M5 20v-3l4-3h6l4 3v3",
    "product": "M4 8l8-4 8 4v8l-8 4-8-4zM4 8l8 4 8-4M12 12v8",
    "order": "M6 4h12v17H6zM9 9h6M9 13h6M9 17h3",
    "billing": "M6 3h12v18l-3-2-3 2-3-2-3 2zM9 8h6M9 12h6",
    "charging": "M13 3L6 13h5l-1 8 8-11h-6z",
    "marketplace": "M4 9l2-5h12l2 5v2H4zM6 11v9h12v-9M10 20v-5h4v5",
    "loyalty": "M12 20C2 13 5 4 12 9c7-5 10 4 0 11z",
    "data": "M4 18l5-6 4 3 7-9M4 21h16",
    "operation": "M9 12a3 3 0 1 0 6 0a3 3 0 1 0-6 0M12 3v4M12 17v4M3 12h4M17 12h4",
    "crm": "M4 5h16v11h-9l-4 4v-4H4zM8 9h8M8 12h5",
    "arrow": "M4 12h15M13 6l6 6-6 6",
}


def catalog_svg(name: Column, color: Column, label: Column) -> Column:
    """SVG text of an icon: its name is normalised, a wrong colour is dark grey, the label is its title."""
    table = F.create_map(*[F.lit(x) for pair in STROKES.items() for x in pair])
    path = F.coalesce(F.try_element_at(table, icon_key(name)), F.lit(STROKES["application"]))
    return F.format_string(
        '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 24 24"><title>%s</title>'
        '<path d="%s" fill="none" stroke="#%s" stroke-width="1.6" stroke-linecap="round"/></svg>',
        escaped_xml(text_or_empty(label)), path, clean_hex(color, "333333"),
    )


def catalog_uri(name: Column, color: Column, label: Column) -> Column:
    return svg_data_uri(catalog_svg(name, color, label))
