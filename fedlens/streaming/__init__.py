"""Run logs and client state that grow while a run is going on."""
