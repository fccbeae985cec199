"""Table access, the keyed result store and the marketplace view of the test tables."""
