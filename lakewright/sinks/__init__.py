"""Writers: table write modes with a commit log, and query export."""
