"""Reading sessions, archives and pushes."""
