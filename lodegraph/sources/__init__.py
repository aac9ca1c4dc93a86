"""Where repositories come from: folders, git, manifests."""
