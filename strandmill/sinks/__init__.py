"""Writers with stable bytes, checksums and append-only rules."""

from strandmill.sinks.files import append_only, checksums, copy_verified, empty_dir, manifest, prefix_append, write_tsv
from strandmill.sinks.reports import delivery_pack, explain_chain, html_report, markdown_report

__all__ = ["append_only", "checksums", "copy_verified", "delivery_pack", "empty_dir", "explain_chain", "html_report", "manifest", "markdown_report", "prefix_append", "write_tsv"]
