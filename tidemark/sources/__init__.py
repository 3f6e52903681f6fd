"""Sources and sinks over landed files: feeds, pages, attachments, boards and versions."""
