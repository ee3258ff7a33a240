"""Where data comes from: files, recorded replication frames, the control store."""
