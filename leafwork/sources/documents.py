"""What needs a PDF or image library, as interfaces: a plugin is registered for each, and without one every call says so."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from leafwork.sources.engines import Unavailable

#: The work a plugin can do: its name, and what its function takes and gives.
INTERFACES = {
    "page_count": "(document bytes) -> int", "rasterise": "(document bytes, page, zoom) -> (png bytes, width, height)", "text_layer": "(document bytes, laid out pages) -> (document bytes, thumbnail)", "overlay": "(document bytes, page, laid out blocks) -> png bytes",
    "reencode": "(image bytes, mode, quality, downscale) -> image bytes or None", "linearise": "(document bytes) -> document bytes", "insert_lines": "(page handle, lines) -> None",
}
_PLUGINS: dict[str, Callable] = {}


def register(name: str, work: Callable) -> None:
    if name not in INTERFACES:
        raise ValueError(f"no interface {name!r}")
    _PLUGINS[name] = work


def plugin(name: str) -> Callable:
    if name not in INTERFACES:
        raise ValueError(f"no interface {name!r}")
    if name not in _PLUGINS:
        raise Unavailable(f"{name} {INTERFACES[name]} needs a plugin, and none is registered")
    return _PLUGINS[name]


def scan_pages(documents, zoom: float = 2.0):
    """(``id``, ``page_index``, ``image``, ``width``, ``height``, ``error``) of every page of (``id``, ``content``), drawn at ``zoom``; a page that cannot be drawn has its error."""
    count, draw = plugin("page_count"), plugin("rasterise")

    def work(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            for i, content in zip(pdf["id"], pdf["content"]):
                rows = []
                for page in range(count(content)):
                    try:
                        rows.append((i, page, *draw(content, page, zoom), None))
                    except Exception as x:  # a plugin may raise anything
                        rows.append((i, page, None, None, None, f"{type(x).__name__}: {x}"))
                yield pd.DataFrame(rows, columns=["id", "page_index", "image", "width", "height", "error"]).astype({"width": "Int64", "height": "Int64"})

    return documents.select("id", "content").mapInPandas(work, "id string, page_index int, image binary, width long, height long, error string")


def recompress(data: bytes, mode: str = "jpeg", quality: int = 75, downscale: int | None = None) -> bytes | None:
    """An image encoded anew; None where that fails or the result is not smaller."""
    try:
        new = plugin("reencode")(data, mode, quality, downscale)
    except Unavailable:
        raise
    except Exception:  # a plugin may raise anything
        return None
    return new if new is not None and len(new) < len(data) else None


def save_linearised(data: bytes) -> tuple[bytes, bool]:
    """The document linearised, and whether it is: where that fails it stays as it was."""
    try:
        return plugin("linearise")(data), True
    except Unavailable:
        raise
    except Exception:  # a plugin may raise anything
        return data, False
