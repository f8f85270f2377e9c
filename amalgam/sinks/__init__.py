"""Writers: RIS, JSON lines and reports."""
