"""Tables: readers, views and the snapshot store."""
