"""Plan builders: series embedding and global ranks."""
