"""Fixed values of the audits, rewrites and classifications, stated plainly and in natural order."""

from __future__ import annotations

#: Fixed values: (analyzer, code, points, severity).
PENALTIES = (
    ("css", "FIX_TEXT_ALIGN", 5, "warning"),
    ("css", "FIX_FLOAT", 5, "warning"),
    ("css", "FIX_MARGIN_LEFT", 5, "warning"),
    ("css", "FIX_MARGIN_RIGHT", 5, "warning"),
    ("css", "FIX_PADDING_LEFT", 5, "warning"),
    ("css", "FIX_PADDING_RIGHT", 5, "warning"),
    ("css", "FIX_BORDER_LEFT", 5, "warning"),
    ("css", "FIX_BORDER_RIGHT", 5, "warning"),
    ("css", "FIX_LEFT_POSITION", 5, "warning"),
    ("css", "FIX_RIGHT_POSITION", 5, "warning"),
    ("css", "FIX_BORDER_TOP_LEFT_RADIUS", 5, "warning"),
    ("css", "FIX_BORDER_TOP_RIGHT_RADIUS", 5, "warning"),
    ("css", "FIX_BORDER_BOTTOM_RIGHT_RADIUS", 5, "warning"),
    ("css", "FIX_BORDER_BOTTOM_LEFT_RADIUS", 5, "warning"),
    ("css", "FIX_BORDER_RADIUS_SHORTHAND", 5, "warning"),
    ("css", "FIX_PADDING_SHORTHAND", 5, "warning"),
    ("css", "FIX_MARGIN_SHORTHAND", 5, "warning"),
    ("html", "MISSING_HEADER", 20, "warning"),
    ("html", "MISSING_NAV", 20, "warning"),
    ("html", "MISSING_FOOTER", 20, "warning"),
    ("html", "MISSING_META_CHARSET", 5, "warning"),
    ("html", "MISSING_META_VIEWPORT", 5, "warning"),
    ("html", "MISSING_META_DESCRIPTION", 5, "warning"),
    ("html", "MISSING_META_KEYWORDS", 5, "warning"),
    ("html", "MISSING_META_AUTHOR", 5, "warning"),
    ("html", "MISSING_LANG_ATTRIBUTE", 5, "warning"),
    ("html", "MISSING_DIR_ATTRIBUTE", 5, "warning"),
    ("html", "PARSE_ERROR", 100, "critical"),
    ("jsx", "AVOID_PHYSICAL_PROP", 5, "warning"),
    ("jsx", "AVOID_TEXT_ALIGN", 5, "warning"),
    ("jsx", "AVOID_FLOAT", 5, "warning"),
    ("jsx", "AVOID_BORDER_RADIUS_SHORTHAND", 5, "warning"),
    ("jsx", "DETECTED_DIRECTIONAL_CLASS_NAME", 5, "warning"),
    ("jsx", "AVOID_PHYSICAL_MARGIN_PADDING_CLASS", 5, "warning"),
    ("jsx", "MISSING_HEADER", 0, "info"),
    ("jsx", "MISSING_FOOTER", 0, "info"),
    ("jsx", "PARSE_ERROR", 100, "critical"),
)

#: Physical CSS property, logical property, code.
CSS_PROPS = (
    ("margin-left", "margin-inline-start", "FIX_MARGIN_LEFT"),
    ("margin-right", "margin-inline-end", "FIX_MARGIN_RIGHT"),
    ("padding-left", "padding-inline-start", "FIX_PADDING_LEFT"),
    ("padding-right", "padding-inline-end", "FIX_PADDING_RIGHT"),
    ("border-left", "border-inline-start", "FIX_BORDER_LEFT"),
    ("border-right", "border-inline-end", "FIX_BORDER_RIGHT"),
    ("left", "inset-inline-start", "FIX_LEFT_POSITION"),
    ("right", "inset-inline-end", "FIX_RIGHT_POSITION"),
    ("border-top-left-radius", "border-start-start-radius", "FIX_BORDER_TOP_LEFT_RADIUS"),
    ("border-top-right-radius", "border-start-end-radius", "FIX_BORDER_TOP_RIGHT_RADIUS"),
    ("border-bottom-right-radius", "border-end-end-radius", "FIX_BORDER_BOTTOM_RIGHT_RADIUS"),
    ("border-bottom-left-radius", "border-end-start-radius", "FIX_BORDER_BOTTOM_LEFT_RADIUS"),
)
#: Four-part shorthands and what their parts become.
CSS_SHORTHANDS = {
    "border-radius": ("border-start-start-radius", "border-start-end-radius", "border-end-end-radius", "border-end-start-radius"),
    "margin": ("margin-block-start", "margin-inline-end", "margin-block-end", "margin-inline-start"),
    "padding": ("padding-block-start", "padding-inline-end", "padding-block-end", "padding-inline-start"),
}

#: Physical style keys that are findings wherever they stand.
JSX_STRICT = (
    "marginLeft", "marginRight", "paddingLeft", "paddingRight", "borderLeft", "borderRight", "borderLeftWidth", "borderRightWidth",
    "borderLeftColor", "borderRightColor", "borderLeftStyle", "borderRightStyle", "borderTopLeftRadius", "borderTopRightRadius",
    "borderBottomLeftRadius", "borderBottomRightRadius",
)
#: Keys that are findings in a style only.
JSX_AMBIGUOUS = ("left", "right")
#: Keys by which an object is known as a style.
JSX_STYLE_SIBLINGS = ("position", "display", "backgroundColor", "fontSize", "zIndex", "width", "height", "color", "top", "bottom", "flex", "grid")
#: Values that show a mapping table, not a style.
JSX_LOGICAL = (
    "marginInlineStart", "marginInlineEnd", "paddingInlineStart", "paddingInlineEnd", "borderInlineStart", "borderInlineEnd",
    "borderStartStartRadius", "borderStartEndRadius", "borderEndStartRadius", "borderEndEndRadius", "insetInlineStart", "insetInlineEnd",
    "start", "end", "inline-start", "inline-end",
)
#: Physical style key, logical style key.
JSX_KEYS = (
    ("marginLeft", "marginInlineStart"), ("marginRight", "marginInlineEnd"),
    ("paddingLeft", "paddingInlineStart"), ("paddingRight", "paddingInlineEnd"),
    ("borderLeft", "borderInlineStart"), ("borderRight", "borderInlineEnd"),
    ("borderTopLeftRadius", "borderStartStartRadius"), ("borderTopRightRadius", "borderStartEndRadius"),
    ("borderBottomLeftRadius", "borderEndStartRadius"), ("borderBottomRightRadius", "borderEndEndRadius"),
    ("left", "insetInlineStart"), ("right", "insetInlineEnd"),
    ("borderLeftWidth", "borderInlineStartWidth"), ("borderRightWidth", "borderInlineEndWidth"),
    ("borderLeftColor", "borderInlineStartColor"), ("borderRightColor", "borderInlineEndColor"),
    ("borderLeftStyle", "borderInlineStartStyle"), ("borderRightStyle", "borderInlineEndStyle"),
)

#: Variants of a class that may be peeled off.
CLASS_VARIANTS = ("sm", "md", "lg", "xl", "2xl", "hover", "focus", "dark")
CLASS_EXACT = (("text-left", "text-start"), ("text-right", "text-end"))
#: Physical prefix, logical prefix; the first that fits counts.
CLASS_PREFIXES = (
    ("rounded-tl-", "rounded-ss-"), ("rounded-tr-", "rounded-se-"), ("rounded-bl-", "rounded-es-"), ("rounded-br-", "rounded-ee-"),
    ("rounded-l-", "rounded-is-"), ("rounded-r-", "rounded-ie-"), ("border-l-", "border-is-"), ("border-r-", "border-ie-"),
    ("-left-", "-start-"), ("-right-", "-end-"), ("left-", "start-"), ("right-", "end-"),
    ("-ml-", "-ms-"), ("-mr-", "-me-"), ("ml-", "ms-"), ("mr-", "me-"), ("pl-", "ps-"), ("pr-", "pe-"),
)
#: The same for version 2 with a plugin; prefixes not named here are as above.
CLASS_PREFIXES_V2 = {
    "-left-": "-inline-start-", "-right-": "-inline-end-", "left-": "inline-start-", "right-": "inline-end-",
    "-ml-": "-mis-", "-mr-": "-mie-", "ml-": "mis-", "mr-": "mie-", "pl-": "pis-", "pr-": "pie-",
}

#: Languages written from right to left.
RTL_LOCALES = ("ar", "he", "fa", "ur", "ku", "dv", "ps", "sd", "ug", "yi")
#: Labels of common languages; others are shown by their code in capitals.
LOCALE_LABELS = {
    "ar": "Arabic", "bn": "Bangla", "cs": "Czech", "da": "Danish", "de": "German", "el": "Greek", "en": "English", "es": "Spanish",
    "fa": "Persian", "fi": "Finnish", "fr": "French", "he": "Hebrew", "hi": "Hindi", "hu": "Hungarian", "id": "Indonesian", "it": "Italian",
    "ja": "Japanese", "ko": "Korean", "ku": "Kurdish", "nl": "Dutch", "no": "Norwegian", "pl": "Polish", "ps": "Pashto", "pt": "Portuguese",
    "ro": "Romanian", "ru": "Russian", "sd": "Sindhi", "sv": "Swedish", "th": "Thai", "tr": "Turkish", "ug": "Uyghur", "uk": "Ukrainian",
    "ur": "Urdu", "vi": "Vietnamese", "yi": "Yiddish", "zh": "Chinese", "dv": "Divehi",
}

#: Element, role of its text in a key.
ELEMENT_ROLES = {"h1": "title", "h2": "subtitle", "h3": "heading", "p": "body", "button": "cta", "a": "cta", "li": "item", "span": "label", "label": "label"}
#: Attributes whose text is shown, and attributes whose expressions are never or always wrapped.
SHOWN_ATTRIBUTES = ("placeholder", "title", "alt", "aria-label")
NEVER_WRAP = ("className", "key", "id", "href", "src", "onClick", "style", "type", "tabIndex", "to", "as", "htmlFor")
ALWAYS_WRAP = ("aria-label", "placeholder", "title", "children")
#: Inline tags that stay in a rich text by name.
INLINE_TAGS = ("strong", "b", "em", "i", "br")
#: Folders whose sources hold data, not components.
DATA_FOLDERS = ("src/config", "src/data", "src/content", "src/constants")
DATA_FILE_FOLDERS = ("/data/", "/content/", "/constants/", "/config/", "/lib/")
SOURCE_ROOTS = ("src", "app", "pages", "components")
#: Drawings that may be mirrored as they are.
GRAPHIC_TAGS = (
    "svg", "img", "picture", "canvas", "video", "path", "circle", "rect", "polygon", "polyline", "line", "g", "defs", "use", "symbol",
    "clipPath", "mask",
)
#: Methods that are not fields of data.
METHOD_NAMES = (
    "map", "filter", "reduce", "forEach", "find", "some", "every", "flat", "flatMap", "sort", "slice", "join", "split", "indexOf",
    "includes", "replace", "trim", "toLowerCase", "toUpperCase", "toString", "charAt", "concat",
)
#: Entities of provider answers, in the order in which they are undone.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x2F;", "/"))
