"""Readers and writers of measurements."""

from .excel import read_excel
from .readers import find_and_replace, header_length, join_files, list_files, read_mat, read_model_output, read_text, remove_empty_lines
from .sinks import log_removed, to_west, write_series, write_west

__all__ = ["find_and_replace", "header_length", "join_files", "list_files", "log_removed", "read_excel", "read_mat", "read_model_output", "read_text", "remove_empty_lines", "to_west", "write_series", "write_west"]
